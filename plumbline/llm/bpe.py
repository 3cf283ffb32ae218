"""Byte-level BPE in linear time: longest matches from an Aho-Corasick automaton, backtracking on seams.

A sequence of tokens is the result of the merges exactly if each token comes out of its own bytes and no
merge crosses a seam between neighbours. Whether one does depends on the two tokens only, so the answer is
kept per pair. The valid prefix that ends at a position is unique, so a position where no token fits is
given up for good, and the number of steps is linear in the length.

Bytes are mapped to the Latin-1 characters of the same number, since the automaton takes str.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_bytes, with_columns

#: How many answers and pieces a worker keeps before it starts anew, and the characters of a piece that is kept at most:
#: bounds on memory, not on input.
MEMO, KEPT = 300_000, 48

#: Latin letters, as ranges for a character class.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Whether a text has none but those letters, digits and ASCII's other characters, on which both engines agree.
PLAIN = re.compile("[\x00-\x1b\x20-\x7f" + LETTERS + "]*").fullmatch


def plain_pattern(pattern: str):
    """findall of the pattern for plain texts, or None if it names classes other than letters and numbers."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}0-9]")
    told = inside.replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in told or r"\P" in told else re.compile(told).findall


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks in the content of a rank file: a token in base64 and its rank, a line each."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class BytePairEncoder:
    """Encodes and decodes by ranks; every byte must be a token, as in any byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks, self.token = ranks, {r: t for t, r in ranks.items()}
        self._any = regex.compile(pattern).findall
        self._plain = plain_pattern(pattern)
        self._spines: dict[int, tuple | None] = {}
        self._seams: dict[int, bool] = {}
        self._shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.length = {r: len(t) for t, r in ranks.items()}
        self.usable = {t.decode("latin-1"): r for t, r in ranks.items() if self.spines(r) is not None}
        for said, rank in self.usable.items():
            self.automaton.add_word(said, rank)
        self.automaton.make_automaton()
        self.widest = max(map(len, self.usable))
        self._pieces: dict[str, str] = {}

    def pieces_of(self, text: str) -> list[str]:
        """The matches of the pattern, in order; where all characters are plain ones, found by a cheaper engine."""
        return self._plain(text) if self._plain and PLAIN(text) else self._any(text)

    def merged(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """The plain merges, least rank first and leftmost among equals; only those of ranks under below."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
            rank, i = min(found)
            if rank == 1 << 60 or (below is not None and rank >= below):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spines(self, rank: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The tokens at the left and right edge of a token while it is merged, smallest first.

        None for a token that its own bytes don't merge to; such a token only stands for a whole piece.
        """
        if rank not in self._spines:
            token = self.token[rank]
            if len(token) == 1:
                self._spines[rank] = ((rank,), (rank,))
            else:
                halves = self.merged(token, rank)
                inner = [self.spines(self.ranks[h]) for h in halves] if len(halves) == 2 else [None]
                self._spines[rank] = None if None in inner else ((*inner[0][0], rank), (*inner[1][1], rank))
        return self._spines[rank]

    def seam_holds(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two tokens: replays the merges at both edges by rank."""
        held = self._seams.get(left << 32 | right)
        if held is None:
            a, b, i, j = self.spines(left)[1], self.spines(right)[0], 0, 0
            last = 1 << 60
            while True:
                across = self.ranks.get(self.token[a[i]] + self.token[b[j]], last)
                next_a = a[i + 1] if i + 1 < len(a) else last
                next_b = b[j + 1] if j + 1 < len(b) else last
                # Of equal ranks the leftmost merges first: the left token's own, then the seam's.
                if across < next_a and across <= next_b and across < last:
                    held = False
                    break
                if next_a == next_b == last:
                    held = True
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
            if len(self._seams) >= 2 * MEMO:
                self._seams.clear()
            self._seams[left << 32 | right] = held
        return held

    def longest(self, said: str, at: int) -> int:
        """The longest token that starts there; as every byte is a token, the leftmost match from there on does."""
        return next(self.automaton.iter_long(said[at : at + self.widest]))[1]

    def shorter(self, rank: int) -> int | None:
        """The next shorter token that a token begins with."""
        if rank not in self._shorter:
            said = self.token[rank].decode("latin-1")
            self._shorter[rank] = next((r for n in range(len(said) - 1, 0, -1) if (r := self.usable.get(said[:n])) is not None), None)
        return self._shorter[rank]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        said, n, at, seams, length = piece.decode("latin-1"), len(piece), 0, self._seams, self.length
        out: list[int] = []
        dead: set[int] = set()
        last, rank = -1, self.longest(said, 0)
        while True:
            while rank is not None:
                if at + length[rank] not in dead:
                    if last < 0:
                        break
                    holds = seams.get(last << 32 | rank)
                    if self.seam_holds(last, rank) if holds is None else holds:
                        break
                rank = self.shorter(rank)
            if rank is None:
                dead.add(at)
                given_up = out.pop()
                at -= length[given_up]
                last, rank = out[-1] if out else -1, self.shorter(given_up)
                continue
            out.append(rank)
            at += length[rank]
            if at == n:
                return out
            last, rank = rank, self.longest(said, at)

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same in decimal joined by commas."""
        kept, found = self._pieces, self.pieces_of(text)
        if len(kept) >= MEMO:
            kept.clear()
        long = {}
        for piece in found:
            if piece not in kept and piece not in long:
                # Kept as text alone, a third of what tuples of numbers beside it take.
                (kept if len(piece) <= KEPT else long)[piece] = ",".join(map(str, self.encode_piece(piece.encode())))
        said = ",".join([kept[piece] if len(piece) <= KEPT else long[piece] for piece in found])
        return list(map(int, said.split(","))) if said else [], said

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(content: bytes, pattern: str) -> BytePairEncoder:
    """A worker's encoder for a rank file's content, made once in each process."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BytePairEncoder(read_ranks(content), pattern)
    return _ENCODERS[key]


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every whole text; a null text is an empty one, and an empty one has no ids.

    The vocabulary's file is read on the driver and sent to each executor once; it is of fixed size. Rows are
    independent: repeated rows give repeated rows, a null doc_id stays null, other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_content(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, pattern)
        for ids, texts in with_columns(batches):
            rows = [enc.encode(t.decode())[0] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, content) of (doc_id, ids), content as bytes; null ids give empty content."""
    sent = tokens.sparkSession.sparkContext.broadcast(_content(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, pattern)
        for ids, rows in with_columns(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([enc.decode(r or []) for r in rows], pa.binary())], ["doc_id", "content"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, content binary")


def digest_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Digests of the ids and of what they decode to, made where the ids are, so that no ids travel.

    Null and empty texts have no ids: n_tokens 0 and the digests of nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_content(vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, pattern)
        for ids, texts in with_columns(batches):
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                found, said = enc.encode(text.decode())
                rows.append((doc, len(found), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(enc.decode(found)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
