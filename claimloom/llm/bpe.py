"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The encoding of a byte string is the one path of tokens in which every two
neighbours are what the merges make of their joined bytes; dropping the last
token of an encoding leaves the encoding of the rest. So the last token after
each byte follows from the last tokens after earlier bytes. A state of the
transducer holds the places from which a token can still grow, each with the
tokens that lead there from the last place that all share. What all share is
emitted: the lookahead is bounded by the longest token. States and transitions
are made when first met, up to a number; where a transition is missing then, the
rest of the piece runs on the places themselves, without a state for them.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import util

START = -1


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encodes byte strings by merge ranks."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 50_000, max_pairs: int = 500_000):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.prefixes = {t[:k] for t in ranks for k in range(len(t))}
        self.max_states, self.max_pairs = max_states, max_pairs
        first = (b"", ((0, (START,)),))
        self.states, self.ids = [first], {first: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first; for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` in an encoding."""
        found = self.pairs.get(left << 32 | right)
        if found is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            if left == START:
                found = self.merged(self.tokens[right]) == [right]
            else:
                found = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            self.pairs[left << 32 | right] = found
        return found

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        suffix, places = self.states[state]
        grown = suffix + bytes((byte,))
        end = None
        for at, path in places:
            token = self.ranks.get(grown[at:])
            if token is not None and self.fits(path[-1], token):
                end = (len(grown), (*path, token))
                break
        if end is None:
            raise ValueError(f"no token covers byte {byte}")
        live = [(at, path) for at, path in places if grown[at:] in self.prefixes]
        live.append(end)
        shift = live[0][0]
        paths = [p for _, p in live]
        shared = os.path.commonprefix(paths)
        out = tuple(shared[1:])
        cut = len(shared) - 1
        made = (grown[shift:], tuple((at - shift, p[cut:]) for at, p in live))
        to = self.ids.get(made)
        if to is None:
            to = self.ids[made] = len(self.states)
            self.states.append(made)
            self.moves.append({})
        self.moves[state][byte] = (to, out)
        return to, out

    def _rest(self, state: int, piece: bytes, at: int) -> list[int]:
        """Tokens of a piece from ``at`` on, where the transducer is in ``state``."""
        suffix, places = self.states[state]
        ranks, prefixes, pairs, fits = self.ranks, self.prefixes, self.pairs, self.fits
        live = []
        for place, path in places:
            link = None
            for token in path[1:]:
                link = (link, token)
            live.append((at - len(suffix) + place, path[-1], link))
        for end in range(at + 1, len(piece) + 1):
            still, made = [], None
            for x in live:
                grown = piece[x[0] : end]
                if made is None:
                    token = ranks.get(grown)
                    if token is not None:
                        ok = pairs.get(x[1] << 32 | token)
                        if ok or ok is None and fits(x[1], token):
                            made = (end, token, (x[2], token))
                if grown in prefixes:
                    still.append(x)
            if made is None:
                raise ValueError(f"no token covers byte {piece[end - 1]}")
            still.append(made)
            live = still
        out, link = [], live[-1][2]
        while link:
            link, token = link
            out.append(token)
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out, state, moves = [], 0, self.moves
        for i, byte in enumerate(piece):
            step = moves[state].get(byte)
            if step is None:
                if len(self.states) >= self.max_states:
                    return out + self._rest(state, piece, i)
                step = self._move(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        out += self.states[state][1][-1][1][1:]
        return out


def _utf8_table() -> list[bytes]:
    """Next state by state and byte. 0: between characters; 8: not UTF-8."""
    rows = [bytearray([8] * 256) for _ in range(8)]
    ranges = [
        (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 2), (0, 0xE1, 0xEC, 3), (0, 0xED, 0xED, 4), (0, 0xEE, 0xEF, 3),
        (0, 0xF0, 0xF0, 5), (0, 0xF1, 0xF3, 6), (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0), (2, 0xA0, 0xBF, 1), (3, 0x80, 0xBF, 1),
        (4, 0x80, 0x9F, 1), (5, 0x90, 0xBF, 3), (6, 0x80, 0xBF, 3), (7, 0x80, 0x8F, 3),
    ]
    for state, low, high, to in ranges:
        for byte in range(low, high + 1):
            rows[state][byte] = to
    return [bytes(r) for r in rows]


class Utf8Stream:
    """Incremental UTF-8 decoding: text comes out as soon as its characters are whole.

    The machine's state is kept between calls. Only the bytes after the last
    boundary known to be safe walk through the table; malformed sequences become
    U+FFFD, one for each longest part that could have begun a character.
    """

    TABLE = _utf8_table()

    def __init__(self):
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        start = max(0, len(data) - 3)
        while start > 0 and start > len(data) - 6 and 0x80 <= data[start] <= 0xBF:
            start -= 1
        state, whole = 0, start
        for i in range(start, len(data)):
            state = self.TABLE[state][data[i]]
            if state == 8:  # start again at this byte if it can begin a character
                state = self.TABLE[0][data[i]]
                if state == 8:
                    state = 0
                whole = i
            if state == 0:
                whole = i + 1
        self.pending = data[whole:] if state else b""
        return data[: len(data) - len(self.pending)].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def decode_stream(tokens: list[bytes], ids, chunk: int = 4096):
    """Text of token ids, piece by piece."""
    stream = Utf8Stream()
    for i in range(0, len(ids), chunk):
        yield stream.feed(b"".join([tokens[k] for k in ids[i : i + chunk]]))
    yield stream.close()


class Codec:
    """A pattern that splits texts, and the transducer; remembers pieces up to a bound."""

    def __init__(self, ranks_data: bytes, pattern: str, max_pieces: int = 400_000):
        import regex

        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(load_ranks(ranks_data), max_pairs=max_pieces)
        self.max_pieces = max_pieces
        self.pieces: dict[str, bytes] = {}

    def _packed(self, piece: str) -> bytes:
        if len(self.pieces) >= self.max_pieces:
            self.pieces.clear()
        out = np.array(self.transducer.encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self.pieces[piece] = out
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, packed = self.pieces, self._packed
        return b"".join([known.get(p) or packed(p) for p in self.split(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids) -> str:
        return "".join(decode_stream(self.transducer.tokens, ids))


_codecs: dict[str, Codec] = {}


def codec(ranks_data: bytes, pattern: str, max_pieces: int = 400_000) -> Codec:
    """One codec for each vocabulary and process; ``max_pieces`` bounds what it remembers, not what it encodes."""
    key = hashlib.sha256(ranks_data + f"{max_pieces} {pattern}".encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks_data, pattern, max_pieces)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_data: bytes, pattern: str, keep_ids: bool = True, max_pieces: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    The ids are decoded again; ``decoded_sha256`` is of that text. Null and empty
    texts have no tokens. Repeated rows stay; very long texts are taken whole; an
    empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks_data)  # a vocabulary file: its size is fixed
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches):
        c = codec(held.value, pattern, max_pieces)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                counts, hashes, decoded, ids = [], [], [], []
                for text in rows.column(1).to_pylist():
                    packed = c.encode_packed(text or "")
                    found = np.frombuffer(packed, dtype="<u4")
                    counts.append(len(found))
                    hashes.append(hashlib.sha256(packed).hexdigest())
                    out = hashlib.sha256()
                    for piece in decode_stream(c.transducer.tokens, found.tolist()):
                        out.update(piece.encode())
                    decoded.append(out.hexdigest())
                    if keep_ids:
                        ids.append(found.astype("int32"))
                cols = [rows.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
                    flat = np.concatenate(ids) if ids else np.zeros(0, "int32")
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """Bytes of the ranks file and the split pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(util.table(spark, sf_dir, "documents"), *vocabulary(), keep_ids=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, the digests and ids; the last stage, so other columns do not come along.

    Remembers fewer pieces than the query, as its workers also serve the stages before.
    """
    return encode_documents(docs, *vocabulary(), max_pieces=150_000)
