"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

BPE with ranks has one encoding per byte string, and dropping the last token of an
encoding leaves the encoding of the remaining prefix. So the whole encoding of a piece is
held by one number per byte prefix: its last token. The token that ends at byte i is the
only vocabulary entry t with `(last[i - len(t)], t)` a *stable pair*, that is two
tokens that plain merging would leave side by side. Appending bytes only adds entries;
after an edit the entries before it stay, and those after it are the old ones again as
soon as one longest token's length of them agrees.

Cases: null and empty texts give no tokens; special tokens are ordinary text; any
repetition of rows or ids is kept row by row; columns other than the text are passed
through or left out by the caller, and may have any name but those of the results, which
are replaced; texts of any length are encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm.common import free_name, kept_in_worker, slices, texts

#: Pieces before an edit that are cut anew: a contraction (x ' l l) spans three.
RECUT = 4

#: Pieces of a worker's cache, and their ids; when it is full, half of it stays, the most used ones.
CACHE_PIECES = 250_000
CACHE_IDS = 4_000_000


def spans(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start, start + 1, ... of each span, all in one array, and where each span begins in it, with its end."""
    begins = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if max(begins[-1], start.max(initial=0) + size.max(initial=0)) < 1 << 31 else np.int64
    return np.arange(begins[-1], dtype=kind) + np.repeat((start - begins[:-1]).astype(kind), size), begins


class Vocabulary:
    """Ranks of byte strings, with the merge structure worked out where it is needed."""

    def __init__(self, rank_file: bytes, pattern: str):
        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.ranks: dict[bytes, int] = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens: dict[int, bytes] = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks), default=1)
        ends: dict[bytes, set[int]] = {}
        for token in self.ranks:
            ends.setdefault(token[-3:], set()).add(len(token))
        #: Lengths of the entries that end in three given bytes, longest first; shorter ends are always tried.
        self._lengths = {end: (*sorted((n for n in found if n > 2), reverse=True), 2, 1) for end, found in ends.items() if len(end) == 3}
        compiled = regex.compile(pattern)
        self.split = compiled.findall
        #: Matches from a place on.
        self.cut = lambda text, at: compiled.finditer(text, at)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._stable: dict[tuple[int, int], bool] = {}
        self._table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def merged(self, data: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """Plain merging, lowest rank first and leftmost first: the tokens and the last pair merged. Used on single tokens only."""
        parts, last = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            last = (self.ranks[parts[i]], self.ranks[parts[i + 1]])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts], last

    def halves(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge makes the token; None for a single byte; (-1, -1) where merging never makes it."""
        if token not in self._halves:
            data = self.tokens[token]
            if len(data) == 1:
                self._halves[token] = None
            else:
                made, last = self.merged(data)
                self._halves[token] = last if made == [token] else (-1, -1)
        return self._halves[token]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens along one edge (side 1: right, 0: left) while `token` was built, latest first, each with the rank that ended it."""
        known = self._edges[side]
        if token not in known:
            steps, ended, at = [], 1 << 60, token
            while True:
                steps.append((at, ended))
                pair = self.halves(at)
                if pair is None:
                    break
                ended, at = at, pair[side]
            known[token] = steps
        return known[token]

    def stable(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves exactly these two tokens.

        Follow both edges at the seam back in time. Two edge tokens that lived together would
        have merged across the seam if the rank of their union is below both their ends; on
        equal ranks the left place merges first.
        """
        found = self._stable.get((a, b))
        if found is None:
            if len(self._stable) >= 400_000:
                self._stable.clear()
            found = self._stable[a, b] = self._is_stable(a, b)
        return found

    def _is_stable(self, a: int, b: int) -> bool:
        if self.halves(a) == (-1, -1) or self.halves(b) == (-1, -1):
            return False
        left, right = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        ranks, tokens = self.ranks, self.tokens
        while True:
            x, x_end = left[i]
            y, y_end = right[j]
            union = ranks.get(tokens[x] + tokens[y])
            if union is not None and union < x_end and union <= y_end:
                return False
            # Step back over the younger of the two; a single byte is as old as the text.
            x_born = x if i + 1 < len(left) else -1
            y_born = y if j + 1 < len(right) else -1
            if x_born < 0 and y_born < 0:
                return True
            if x_born > y_born:
                i += 1
            else:  # on equal ranks the left merge came first, so the right one is undone first
                j += 1

    def last_tokens(self, data: bytes, known: list[int], stop: int | None = None) -> None:
        """Extends `known`, where known[i] is the last token of the encoding of data[:i] (known[0] is -1), to data[:stop]."""
        ranks, stable, lengths = self.ranks.get, self._stable.get, self._lengths.get
        for end in range(len(known), (len(data) if stop is None else stop) + 1):
            for size in lengths(data[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                start = end - size
                if start < 0:
                    continue
                token = ranks(data[start:end])
                if token is None:
                    continue
                before = known[start]
                if before < 0:
                    if self.halves(token) == (-1, -1):
                        continue
                    known.append(token)
                    break
                ok = stable((before, token))
                if ok or ok is None and self.stable(before, token):
                    known.append(token)
                    break
            else:
                raise ValueError("a byte without a rank")

    def walk_back(self, known: list[int]) -> list[int]:
        """The encoding that a table of last tokens holds."""
        out, at = [], len(known) - 1
        while at > 0:
            out.append(known[at])
            at -= len(self.tokens[known[at]])
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece of the pattern; a piece that is itself a vocabulary entry is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        known = [-1]
        self.last_tokens(piece, known)
        return self.walk_back(known)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_piece(p.encode()) for p in self.split(text)))

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of different pieces. In byte order, each piece takes over the table entries of the prefix that it shares with the one before."""
        out, before, known = {}, b"", [-1]
        for piece in sorted(pieces):  # code points and their UTF-8 bytes have one order
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out[piece] = (whole,)
                continue
            same = 0
            for x, y in zip(before, data, strict=False):
                if x != y:
                    break
                same += 1
            del known[same + 1 :]
            self.last_tokens(data, known)
            out[piece] = tuple(self.walk_back(known))
            before = data
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and where each id's bytes begin, with their end."""
        if self._table is None:
            size = np.zeros(max(self.tokens, default=-1) + 1, np.int64)
            size[list(self.tokens)] = list(map(len, self.tokens.values()))
            self._table = np.frombuffer(b"".join(self.tokens[i] for i in sorted(self.tokens)), np.uint8), np.cumsum(size) - size, size
        data, start, size = self._table
        at, begins = spans(start[ids], size[ids])
        return data[at], begins


class PieceTable:
    """The table of one piece, kept for appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.known = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.last_tokens(self.data, self.known)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces data[start:end]. Returns how many entries were worked out anew."""
        old, shift = self.known, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        known = old[: start + 1]
        agreed, longest = 0, self.vocabulary.longest
        for at in range(start + 1, len(self.data) + 1):
            self.vocabulary.last_tokens(self.data, known, at)
            before = at - shift
            agreed = agreed + 1 if before > end and old[before] == known[at] else 0
            if agreed >= longest:
                known.extend(old[before + 1 :])
                self.known = known
                return at - start
        self.known = known
        return len(self.data) - start

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        return [whole] if whole is not None else self.vocabulary.walk_back(self.known)


class EncodedText:
    """A whole text with its pieces, for exact appends and edits near which alone pieces are cut anew."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, text
        self.pieces = [(p, vocabulary.encode_piece(p.encode())) for p in vocabulary.split(text)]

    def append(self, more: str) -> None:
        """New text can join a contraction or a run of spaces two pieces back, so the last pieces are cut anew."""
        if more:
            self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]: cuts anew from some pieces before the edit until a cut after it falls on an old one."""
        begins, at = [], 0
        for piece, _ in self.pieces:
            begins.append(at)
            at += len(piece)
        first = max(0, bisect.bisect_left(begins, start) - RECUT)
        at = begins[first] if first < len(begins) else at
        old_cuts = {begins[k] + len(new) - (end - start): k for k in range(first, len(begins)) if begins[k] > end}
        self.text = self.text[:start] + new + self.text[end:]
        fresh = []
        for match in self.vocabulary.cut(self.text, at):
            if match.start() in old_cuts:
                self.pieces = self.pieces[:first] + fresh + self.pieces[old_cuts[match.start()] :]
                return
            fresh.append((match[0], self.vocabulary.encode_piece(match[0].encode())))
        self.pieces = self.pieces[:first] + fresh

    def ids(self) -> list[int]:
        return [i for _, ids in self.pieces for i in ids]


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class TextEncoder:
    """Encodes whole texts, many at a time, with a bounded cache of pieces: each has a number, and its ids lie in one array.

    `encode_pieces` (pieces to ids) may be another encoder of the same vocabulary.
    """

    def __init__(self, vocabulary: Vocabulary, encode_pieces: Callable[[Iterable[str]], dict[str, tuple[int, ...]]] | None = None):
        self.vocabulary = vocabulary
        self.encode_pieces = encode_pieces or vocabulary.encode_pieces
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = _Numbers()
        self.ids = np.zeros(0, np.int32)
        self.start, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def trim(self) -> None:
        """Where the cache is full, keeps the most used pieces, up to half of what it may hold."""
        if len(self.known) < CACHE_PIECES and len(self.ids) < CACHE_IDS:
            return
        keep = np.argsort(-self.used, kind="stable")[: CACHE_PIECES // 2]
        keep = keep[np.cumsum(self.size[keep]) <= CACHE_IDS // 2]
        names = list(self.known)
        self.known = _Numbers((names[i], k) for k, i in enumerate(keep.tolist()))
        at, begins = spans(self.start[keep], self.size[keep])
        self.ids, self.start, self.size, self.used = self.ids[at], begins[:-1], self.size[keep], self.used[keep] // 2

    def add(self, pieces: list[str]) -> None:
        """Encodes pieces that have numbers, but no ids yet."""
        found = self.encode_pieces(pieces)
        size = np.fromiter((len(found[p]) for p in pieces), np.int64, len(pieces))
        fresh = np.fromiter(chain.from_iterable(map(found.__getitem__, pieces)), np.int32, int(size.sum()))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, fresh])
        self.used = np.concatenate([self.used, np.zeros(len(pieces), np.int64)])

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins, with their end."""
        self.trim()
        cut = list(map(self.vocabulary.split, texts))
        begins = np.cumsum([0, *map(len, cut)])
        before = len(self.known)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(begins[-1]))
        if len(self.known) > before:
            try:
                self.add(list(islice(self.known, before, None)))
            except ValueError:  # a byte without a rank: no piece may stay without its ids
                self.clear()
                raise
        self.used += np.bincount(number, minlength=len(self.used))
        at, ends = spans(self.start[number], self.size[number])
        return self.ids[at], ends[begins]

    def many(self, texts: list[str]) -> list[list[int]]:
        ids, begins = self.flat(texts)
        return [ids[a:b].tolist() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]

    def __call__(self, text: str) -> list[int]:
        return self.many([text])[0]


def worker_encoder(rank_file: bytes, pattern: str) -> TextEncoder:
    """One encoder a worker process, kept from task to task."""
    return kept_in_worker(("bpe", hash(rank_file), pattern), lambda: TextEncoder(Vocabulary(rank_file, pattern)))


def read_ranks(path: str) -> bytes:
    """The rank file; read on the driver and sent to the workers, which need no copy of it."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds token_ids (array of int) and decoded (the bytes that the ids stand for) to the columns in `keep` (all by default).

    One narrow pass in Python and no shuffle. Null or empty texts: an empty array and no bytes.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("token_ids", "decoded")]
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    name = free_name([*keep, "token_ids", "decoded"], "__text")
    source = df.select(*keep, F.col(text).alias(name))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, pattern)
        for part in slices(batches, rows=1000, chars=2_000_000, text=name):
            ids, begins = encoder.flat(texts(part, name))
            data, at = encoder.vocabulary.bytes_of(ids)
            offsets, places = pa.array(begins, pa.int32()), pa.array(at[begins], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
            decoded = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, places.buffers()[1], pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, decoded], names=[*keep, "token_ids", "decoded"])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids") -> DataFrame:
    """Adds decoded (binary) to rows with an array of ids; a null array or an id outside the vocabulary gives null."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    keep = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("decoded", T.BinaryType())])

    def one(tokens: dict[int, bytes], row: list[int] | None) -> bytes | None:
        found = None if row is None else [tokens.get(i) for i in row]
        return None if found is None or None in found else b"".join(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_encoder(shared.value, pattern).vocabulary.tokens
        for part in slices(batches, rows=200):
            out = pa.array([one(tokens, row) for row in part.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), out], names=[*keep, "decoded"])

    return df.select(*keep).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> list:
    """n_tokens, ids_sha256 and decoded_sha256 of the real ids and bytes."""
    return [
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]


def default_ranks() -> tuple[bytes, str]:
    """The vocabulary that the registered query uses, from the installed vocabulary files."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = default_ranks()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(docs, ranks, pattern, keep=["doc_id"])
    return encoded.select("doc_id", *digests(encoded))
