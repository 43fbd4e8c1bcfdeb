"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

A sequence of tokens is the BPE encoding of its bytes exactly if each token encodes itself and each adjacent pair does so
as a pair. The last token of every prefix is therefore unique, and an encoder needs only, for each position at
which a longer token could still begin, the path of tokens that leads there. Tokens on all those paths are final. A
state is the bytes after the last final token; its transitions (next state, tokens emitted) are made when first taken and
kept. Whether the first of the emitted tokens may follow the one before is looked up when it is emitted; in the rare case
that it may not, the bytes since then are read again from a state that holds the token before as well.
Lookahead is bounded: no token begins more than the longest token's length before the end of what was read.

Decoding joins the tokens' bytes and runs an incremental UTF-8 machine over them, which holds back at most three bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import resident, ship, slices

CACHED_PARTS = 600_000
CACHED_PIECES = 100_000
CACHED_STATES = 1 << 17
CACHED_PAIRS = 1 << 19
LONGEST_CACHED = 48
LONG = 1 << 20
CHUNK = 1 << 16  # ids decoded at a time

# The code points with Unicode's White_Space property, and a splitter for patterns whose matches end before
# white space, but for one space that can begin a match: each match of the pattern lies in one match of the splitter.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]"
BYTES = 4 << 20  # text handled at a time


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks in a file of lines ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class State(dict):
    """By byte: (next state, ids that became final). ``before`` is the token before ``held`` where that still matters."""

    __slots__ = ("before", "begins", "end", "held", "live", "made_by")

    def __init__(self, made_by: Transducer, before: bytes, held: bytes, begins: tuple[int, ...], live: tuple[int, ...]) -> None:
        super().__init__()
        self.made_by, self.before, self.held = made_by, before, held
        self.begins, self.live = begins, live  # where the last token of each prefix begins; where a token may begin
        self.end: tuple[int, ...] | None = None  # the ids of ``held`` if the piece ends here

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        move = self[byte] = self.made_by.move(self, byte)
        return move


class Transducer:
    """Encodes one piece at a time; the tables that it fills lazily are bounded and only save time."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        for t, i in ranks.items():
            if len(t) > 1 and not any(ranks.get(t[:k], i) < i > ranks.get(t[k:], i) for k in range(1, len(t))):
                raise ValueError(f"the token {t!r} joins no two earlier ones")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.open = {t[:n] for t in ranks for n in range(1, len(t))}  # what a longer token can begin with
        self.splits: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.follows: dict[int, bool] = {}  # by left id * 2**32 + right id
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[bytes, bytes], State] = {}
        self.again: dict[tuple[bytes, bytes], tuple[State, tuple[int, ...]]] = {}
        self.start = self._state(b"", b"", (0,), (0,))

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none or ``least`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens that the last merge of ``token`` joins; None for a byte or a token that merges never make."""
        if token not in self.splits:
            parts = self.merged(token, 2) if len(token) > 1 else [token]
            self.splits[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.splits[token]

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether ``right`` can follow ``left``; with an empty ``left``, whether it is the encoding of its own bytes."""
        if len(right) > 1 and self._split(right) is None:
            return False
        if not left:
            return True
        key = self.ranks[left] << 32 | self.ranks[right]
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) >= CACHED_PAIRS:
                self.follows.clear()
            known = self.follows[key] = self._apart(left, right)
        return known

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether no merge crosses the border: play the merges on either side of it backwards, latest first.

        A merge across the border would come before the latest merge undone so far, on the left side at an equal rank too.
        """
        ranks, before = self.ranks, None
        while True:
            across = ranks.get(left + right)
            if across is not None and (before is None or across < before):
                return False
            a = ranks[left] if len(left) > 1 else -1
            b = ranks[right] if len(right) > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:  # at equal ranks the left merge comes first, so the right one is undone first
                before, left = a, self._split(left)[1]
            else:
                before, right = b + 1, self._split(right)[0]

    def _state(self, before: bytes, held: bytes, begins: tuple[int, ...], live: tuple[int, ...]) -> State:
        state = self.states.get((before, held))
        if state is None:
            state = self.states[before, held] = State(self, before, held, begins, live)
        return state

    @staticmethod
    def _path(begins: tuple[int, ...], end: int) -> list[int]:
        """Token borders from ``end`` back to 0."""
        path = [end]
        while path[-1]:
            path.append(begins[path[-1]])
        return path

    def _step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The state after one more byte, and the tokens that became final."""
        before, held, begins, live = state
        held, ranks = held + bytes((byte,)), self.ranks
        for s in live:
            token = held[s:]
            if token in ranks and self._fits(held[begins[s] : s] if s else before, token):
                break
        else:
            raise AssertionError("every prefix has an encoding")
        n = len(held)
        begins, live = (*begins, s), (*[j for j in live if held[j:] in self.open], n)
        ids: tuple[int, ...] = ()
        if live[0]:
            final = n
            path = shared = self._path(begins, n)
            for j in live[:-1]:
                own = set(self._path(begins, j))
                shared = [x for x in shared if x in own]
            final = shared[0]  # the last border that all paths share
            if final:
                path = path[path.index(final) :][::-1]
                tokens = [held[a:b] for a, b in zip(path, path[1:], strict=False)]
                ids = tuple([ranks[t] for t in tokens])
                before, held = tokens[-1], held[final:]
                begins, live = tuple([max(0, x - final) for x in begins[final:]]), tuple([j - final for j in live])
        return (before, held, begins, live), ids

    def move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        full, ids = self._step((state.before, state.held, state.begins, state.live), byte)
        return self._state(b"" if ids else full[0], *full[1:]), ids

    def _reread(self, before: bytes, held: bytes) -> tuple[State, tuple[int, ...]]:
        """State and final tokens after ``held``, which follows ``before``."""
        known = self.again.get((before, held))
        if known is None:
            full, out = (before, b"", (0,), (0,)), ()
            for byte in held:
                full, ids = self._step(full, byte)
                out += ids
            known = self.again[before, held] = self._state(b"" if out else before, *full[1:]), out
        return known

    def _end(self, state: State) -> tuple[int, ...]:
        if state.end is None:
            path = self._path(state.begins, len(state.held))[::-1]
            state.end = tuple([self.ranks[state.held[a:b]] for a, b in zip(path, path[1:], strict=False)])
        return state.end

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece, each token handed on once it is final."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) + len(self.again) > CACHED_STATES:
            self._reset()
        out: list[int] = []
        state, follows = self.start, self.follows
        for byte in piece:
            after, ids = state[byte]
            if ids:
                if out:
                    ok = follows.get(out[-1] << 32 | ids[0])
                    if ok is None:
                        ok = self._fits(self.tokens[out[-1]], self.tokens[ids[0]])
                    if not ok:
                        after, ids = self._reread(self.tokens[out[-1]], state.held + bytes((byte,)))
                out += ids
            state = after
        ids = state.end or self._end(state)
        if out and ids and not (follows.get(out[-1] << 32 | ids[0]) or self._fits(self.tokens[out[-1]], self.tokens[ids[0]])):
            state, ids = self._reread(self.tokens[out[-1]], state.held)
            out += ids
            ids = self._end(state)
        out += ids
        return out


class Pieces(dict):
    """Pieces to their ids as int32; pieces beyond the bound are encoded each time they come."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.transducer, self.missed = Transducer(ranks), 0

    def new(self, piece: str) -> bytes:
        self.missed += 1
        return array("i", self.transducer.encode(piece.encode())).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.new(piece)
        if len(self) < CACHED_PIECES and len(piece) <= LONGEST_CACHED:
            self[piece] = ids
        return ids


class Encoder(dict):
    """Matches of ``splitter`` to the ids of the pieces in them, within a bound too; without a splitter, of whole texts.

    A part that is one piece is kept here alone, not among the pieces as well.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, splitter: str | None) -> None:
        super().__init__()
        self.pieces, self.find, self.split = Pieces(ranks), regex.compile(pattern), splitter and re.compile(splitter)

    def of(self, text: str) -> bytes:
        """The ids of all pieces of ``text``."""
        if len(text) <= LONG:
            return b"".join(map(self.pieces.__getitem__, self.find.findall(text)))
        return b"".join([self.pieces[m.group()] for m in self.find.finditer(text)])  # without a list of all pieces

    def __missing__(self, part: str) -> bytes:
        if len(part) > LONGEST_CACHED:
            return self.of(part)
        found = self.find.findall(part)
        ids = self.pieces.new(found[0]) if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))
        if len(self) < CACHED_PARTS:
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not self.split:
            return self.of(text)
        if len(text) <= LONG:
            return b"".join(map(self.__getitem__, self.split.findall(text)))
        return b"".join([self[m.group()] for m in self.split.finditer(text)])


class Tokens:
    """The bytes of token ids, end to end in one array."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = np.full(max(ranks.values()) + 1, -1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.start = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self.data = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.size) or (size := self.size[ids]).min() < 0:
            raise KeyError("an id that is not in the vocabulary")
        ends = np.cumsum(size)
        return self.data[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + size, size)].tobytes()


class Utf8Stream:
    """An incremental UTF-8 machine: text for the bytes fed so far, but for an unfinished last character."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes can still complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:  # goes on with an earlier lead byte
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if back >= need:
                return 0
            if back > 1:  # the second byte's range depends on the lead byte
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        text, self.held = self.held.decode("utf-8", "replace"), b""
        return text


def decode_stream(chunks: Iterable[np.ndarray], tokens: Tokens) -> Iterator[str]:
    """Text as chunks of ids arrive. An unknown id raises KeyError; ill-formed bytes become U+FFFD."""
    machine = Utf8Stream()
    for ids in chunks:
        yield machine.feed(tokens.join(ids))
    yield machine.close()


def _text(ids: np.ndarray, tokens: Tokens) -> str:
    return "".join(decode_stream((ids[i : i + CHUNK] for i in range(0, len(ids), CHUNK)), tokens))


def encode(docs: DataFrame, ranks_path: str, pattern: str, splitter: str | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>, replaced if there) in place of the text.

    Each match of ``pattern`` in the whole text is encoded separately; a null text has no ids, like an empty one.
    ``splitter`` (``WORDS`` for patterns of its kind) cuts texts into parts that repeat, to save time. With ``decoded_col`` the ids
    are decoded again in the same pass. ``ranks_path`` is read on the driver; its bytes are broadcast (a vocabulary's size,
    whatever the input).
    """
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    docs = docs.drop(*{ids_col, decoded_col or ids_col} - {text_col})
    others = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*others, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    if decoded_col:
        schema = T.StructType([*schema.fields, T.StructField(decoded_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(held.value)
        own = resident(("bpe", hash(held.value), pattern, splitter), lambda: Encoder(ranks, pattern, splitter))
        tokens = Tokens(ranks)
        for whole in batches:
            for b in slices(whole, text_col, BYTES):
                own.pieces.missed = 0
                ids = [own.ids(t) if t else b"" for t in b.column(text_col).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64).astype(np.int32)
                values = np.frombuffer(b"".join(ids), np.int32)
                columns = [*(b.column(f.name) for f in others), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
                if decoded_col:
                    columns.append(pa.array([_text(values[i:j], tokens) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                if own.pieces.missed > len(values) // 3:  # many pieces are new: what is kept may have become stale
                    own.clear()
                    own.pieces.clear()

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``text_col`` (string, replaced if there); null ids give a null text. See ``decode_stream``."""
    spark = encoded.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    encoded = encoded.drop(text_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(read_ranks(held.value))
        for b in batches:
            out = [_text(ids.values.to_numpy(), tokens) if ids.is_valid else None for ids in b.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)


def op10_bpe_transducer(docs: DataFrame) -> DataFrame:
    """The contract's columns: every whole text encoded, and decoded again from the ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, WORDS, decoded_col="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
