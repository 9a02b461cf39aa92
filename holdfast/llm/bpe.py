"""Byte-level BPE encoding and decoding.

The bytes of a piece of text become Latin-1 characters, the trie of an Aho-Corasick
automaton gives the longest match at a start, and the encoder walks from longest to
shorter matches: a token may follow another only if merging their joined bytes gives exactly
these two tokens. That test is memoised per pair. A sequence whose neighbours all
pass is the merge result of its prefix, and no prefix has a second one, so a place
that failed once is never entered again: the walk is linear in the piece.

Pieces repeat, so each worker keeps the ids of the ones it has seen (a bounded memo).
Everything happens in one map over the rows: no shuffle, memory bounded by a batch,
the vocabulary and the memos.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import pieces, texts

#: Entries of a worker's memos: of pieces, in each of two generations, and of pairs.
MEMO, FITS = 1 << 17, 1 << 18
#: Longer pieces are rare and not worth remembering.
MEMO_PIECE = 64

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, ids array<int>, decoded binary"


def read_ranks(path: str) -> bytes:
    """The lines of a rank file: a token in base64, a space, its rank."""
    with open(path, "rb") as file:
        return file.read()


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours of least rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min(
            ((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))),
        )
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def finders(pattern: str) -> tuple[Callable, Callable]:
    """The pattern's matches in any text, and the same in ASCII text by the faster ``re``.

    On ASCII, letters, numbers and white space are short lists. A pattern with other
    Unicode classes has one finder for both.
    """
    any_text = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]")
    plain = plain.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return any_text, any_text if r"\p" in plain.lower() else re.compile(plain, re.ASCII).findall


class Codec:
    """Encodes and decodes with one vocabulary and one splitting pattern.

    Ids travel as decimal text, joined by spaces, as the digests want them.
    """

    def __init__(self, rank_lines: bytes, pattern: str):
        self.ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in rank_lines.splitlines() if line.strip())
        }
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.bytes_of_text = {str(rank): token for token, rank in self.ranks.items()}
        self.find_any, self.find_ascii = finders(pattern)
        spelled = {token.decode("latin-1"): rank for token, rank in self.ranks.items()}
        automaton = ahocorasick.Automaton()
        for token, rank in spelled.items():
            automaton.add_word(token, rank)
        automaton.make_automaton()
        #: Length of the longest vocabulary path at the start of a text, and a token's rank.
        self.longest, self.rank_of = automaton.longest_prefix, spelled.get
        self.widest = max(map(len, spelled), default=0)
        #: Pairs are numbers, the left rank times ``span`` and the right one: half as large as tuples.
        self.fits: dict[int, bool] = {}
        self.span = max(self.bytes_of, default=0) + 1
        #: Pieces seen of late, and those before them: a full memo replaces the older one, so that
        #: frequent pieces stay and the room is bounded.
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' bytes end in exactly these two."""
        if len(self.fits) >= FITS:
            self.fits.clear()
        fit = merge(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        self.fits[left * self.span + right] = fit
        return fit

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece. A whole piece in the vocabulary is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        spelled = piece.decode("latin-1")
        size, fits, rank_of, longest, span = len(piece), self.fits, self.rank_of, self.longest, self.span
        ids: list[int] = []
        trail: list[tuple[int, int]] = []  # start and length of each token
        failed = bytearray(size + 1)
        at, length = 0, longest(spelled[: self.widest])
        while at < size:
            while length:
                rank = rank_of(spelled[at : at + length])
                if rank is not None and not failed[at + length]:
                    if not ids or (
                        fits[pair] if (pair := ids[-1] * span + rank) in fits else self.follows(ids[-1], rank)
                    ):
                        break
                length -= 1
            if length:
                ids.append(rank)
                trail.append((at, length))
                at += length
                length = longest(spelled[at : at + self.widest])
            elif not ids:
                raise ValueError("the vocabulary lacks a byte of the text")
            else:
                failed[at] = 1
                ids.pop()
                at, length = trail.pop()
                length -= 1
        return ids

    def entry(self, piece: str) -> str:
        found = self.older.get(piece) or " ".join(map(str, self.encode_piece(piece.encode())))
        if len(piece) <= MEMO_PIECE:
            if len(self.memo) >= MEMO:
                self.older.clear()
                self.older.update(self.memo)
                self.memo.clear()
            self.memo[piece] = found
        return found

    def encode(self, text: str) -> str:
        known, entry = self.memo.get, self.entry
        find = self.find_ascii if text.isascii() else self.find_any
        return " ".join([known(p) or entry(p) for p in find(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of_text.__getitem__, ids.split()))


@lru_cache(maxsize=2)
def _codec(rank_lines: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(rank_lines, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (bytes of the ids) of every row's whole text.

    A null or empty text has no ids; equal rows give equal rows; other columns are left
    out. The vocabulary (under a megabyte) is read once on the driver and broadcast.
    """
    given = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(given.value, pattern)
        for frame in pieces(frames):
            ids = [codec.encode(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "ids": [list(map(int, i.split())) for i in ids],
                    "decoded": [codec.decode(i) for i in ids],
                }
            )

    return texts(docs).mapInPandas(run, ENCODED)


def digest(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Token count and SHA-256 of the ids and of the decoded bytes of every row.

    The same encoder as ``encode``; the digests are taken where the ids are, so that the
    ids of long texts need not leave the worker. Nulls and copies: as ``encode``.
    """
    given = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(given.value, pattern)
        for frame in pieces(frames):
            # one text's ids at a time are held
            rows = [_digests(codec, codec.encode(t)) for t in frame["text"]]
            found = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            found.insert(0, "doc_id", frame["doc_id"].array)
            yield found

    return texts(docs).mapInPandas(run, DIGESTS)


def _digests(codec: Codec, ids: str) -> tuple[int, str, str]:
    return ids.count(" ") + 1 if ids else 0, _sha256(ids.encode()), _sha256(codec.decode(ids))


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``doc_id`` and ``decoded`` bytes of rows with ``ids`` (null: no ids)."""
    given = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(given.value, "")
        for frame in frames:
            found = [codec.decode(" ".join(map(str, () if i is None else i))) for i in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "decoded": found})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, decoded binary")


def vocabulary(spark: SparkSession, rank_file: str) -> DataFrame:
    """The tokens as rows (``rank``, ``token``)."""
    ranks = Codec(read_ranks(rank_file), "").ranks
    return spark.createDataFrame([(r, bytearray(t)) for t, r in ranks.items()], "rank int, token binary")
