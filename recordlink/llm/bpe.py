"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

A token sequence is the encoding of its bytes exactly if every two neighbours are (Berglund and van der Merwe 2023: BPE
is a local property), so each prefix of a piece has one last token. The transducer reads a byte at a time. Its state is the longest suffix of
what was read that begins some token, with the last token of each prefix that ends inside that suffix; a new token can only start there.
States and transitions are made when first met and kept in bounded tables that are emptied when full. A boundary is emitted as soon
as all last-token chains of the state pass through it, so the lookahead is bounded by the longest token.
Short pieces are read side by side, the first byte of all, then the second: their transitions are found together in an open-addressed table.
Decoding maps ids to bytes and feeds an incremental UTF-8 automaton, which holds at most three bytes between chunks.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlink.llm import common

#: Made-up words in several languages meet some 350,000 states; with 100,000 they were compiled again and again.
MOST_STATES, MOST_PAIRS = 400_000, 400_000
MOST_PIECES = 60_000
LONG_PIECE = 64
#: Slots of the table of transitions (24 MB), five eighths of them taken at most, and pieces of texts that are looked up at once.
SLOTS, BLOCK = 1 << 21, 65_536
#: Texts that a worker turns to Python objects at once.
SLICE = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encoder of pieces for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = {v: k for k, v in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.longest = max(map(len, ranks), default=1)
        self.sizes = np.zeros(max(self.vocab, default=0) + 1, np.int64)  # bytes by token
        self.sizes[list(self.vocab)] = [len(t) for t in self.vocab.values()]
        self.pair_ok: dict[int, bool] = {}  # by both tokens, packed in one number
        self.reachable: dict[int, bool] = {}
        self.slots, self.packed = np.empty(SLOTS, np.int32), np.zeros(SLOTS, np.int64)
        self._clear()

    def _clear(self):
        # state 0: nothing read. A state is the suffix, then the last tokens of the prefixes ending after 0..len(suffix) of its bytes, packed (-1: the beginning, -2: none)
        self.states: list[bytes] = [struct.pack("<i", -1)]
        self.ids: dict[bytes, int] = {self.states[0]: 0}
        self.moves: dict[int, int] = {}  # of long pieces, by 256 * state + byte: next state and last token + 1, packed
        self.slots.fill(-1)  # the keys of short pieces' moves; their values are in ``packed``
        self.used = 0

    def merge(self, piece: bytes) -> list[int]:
        """Plain rank-by-rank merging of a few bytes; used only to compile token pairs."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get, never = self.ranks.get, 1 << 60
        ranks = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == never:
                break
            i = ranks.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]  # only the neighbours' ranks change
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], never)
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if a < 0:
            ok = self.reachable.get(b)
            if ok is None:
                ok = self.reachable[b] = self.merge(self.vocab[b]) == [b]
            return ok
        ok = self.pair_ok.get(a << 32 | b)
        if ok is None:
            if len(self.pair_ok) > MOST_PAIRS:
                self.pair_ok.clear()
            ok = self.pair_ok[a << 32 | b] = self.merge(self.vocab[a] + self.vocab[b]) == [a, b]
        return ok

    def step(self, state: int, byte: int) -> int:
        """Compile a transition: the next state, and the last token of the prefix read so far, packed in one number."""
        known = self.states[state]
        n = len(known) // 5  # a byte and four for each of n bytes, four more for what is before them
        lasts, text = struct.unpack_from(f"<{n + 1}i", known, n), known[:n] + bytes((byte,))
        last, cut, size, prefixes, get = -2, -1, len(text), self.prefixes, self.ranks.get
        for i in range(size):  # the longest token first
            part = text[i:]
            if part not in prefixes:  # and so no token either
                continue
            if cut < 0:
                cut = i
            t = get(part)
            if t is not None and lasts[i] != -2 and self.compatible(-1, t) and (lasts[i] == -1 or self.compatible(lasts[i], t)):
                last = t
                break
        cut = size if cut < 0 else cut
        # a position from which no token can go on is of no use to any later token
        key = text[cut:] + struct.pack(f"<{size - cut + 1}i", *[lasts[i] if text[i:] in prefixes else -2 for i in range(cut, size)], last)
        nxt = self.ids.get(key)
        if nxt is None:
            nxt = self.ids[key] = len(self.states)
            self.states.append(key)
        return nxt << 32 | (0 if last == -2 else last + 1)

    def stream(self, piece: bytes):
        """Tokens of one piece, emitted as soon as no later byte can change them."""
        if piece in self.ranks:
            yield self.ranks[piece]
            return
        if len(self.states) > MOST_STATES:
            self._clear()
        state, base, lasts = 0, 0, []  # lasts[i]: last token of the prefix of length base + i + 1
        vocab, moves = self.vocab, self.moves

        def chain(end: int) -> list[int]:
            out = []
            while end > base:
                t = lasts[end - base - 1]
                out.append(t)
                end -= len(vocab[t])
            return out[::-1]

        for n, byte in enumerate(piece, 1):
            found = moves.get(state << 8 | byte)
            if found is None:
                found = moves[state << 8 | byte] = self.step(state, byte)
            state = found >> 32
            last = found & 0xFFFFFFFF
            lasts.append(last - 1 if last else None)
            if n < LONG_PIECE:
                continue
            if n - base >= LONG_PIECE + 2 * self.longest and len(self.states) <= MOST_STATES:
                # every future token starts in the state's suffix: keep what all those chains share
                chains = [chain(e) for e in range(n - len(self.states[state]) // 5, n + 1) if e > base and lasts[e - base - 1] is not None]
                shared = 0
                while all(len(c) > shared for c in chains) and len({c[shared] for c in chains}) == 1:
                    shared += 1
                for t in chains[0][:shared]:
                    yield t
                    del lasts[: len(vocab[t])]
                    base += len(vocab[t])
            elif len(self.states) > 2 * MOST_STATES:
                key = self.states[state]
                self._clear()
                self.states.append(key)
                self.ids[key] = state = 1
                moves = self.moves
        yield from chain(len(piece))

    def together(self, keys: np.ndarray) -> np.ndarray:
        """The moves of many keys; those met first are compiled and get the next free slot."""
        slots = self.slots
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % len(slots)
        left = np.flatnonzero(slots[at] != keys)
        while len(left):
            taken = slots[at[left]] >= 0
            on, free = left[taken], left[~taken]
            at[on] = (at[on] + 1) % len(slots)
            for k, i in zip(keys[free].tolist(), at[free].tolist()):
                if slots[i] < 0:
                    slots[i], self.packed[i] = k, self.step(k >> 8, k & 255)
                    self.used += 1
            left = left[slots[at[left]] != keys[left]]
        return self.packed[at]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of each piece as little-endian unsigned 32-bit integers; short pieces many at a time."""
        out: list = [None] * len(pieces)
        short = []
        for i, piece in enumerate(pieces):
            if 0 < len(piece) < LONG_PIECE and piece not in self.ranks:
                short.append(i)
            else:
                ids = list(self.stream(piece))
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        short.sort(key=lambda i: -len(pieces[i]))
        lo = 0
        while lo < len(short):  # a part has no more bytes, and so makes no more moves, than an eighth of the slots
            part = short[lo : lo + max(1, len(self.slots) // 8 // len(pieces[short[lo]]))]
            lo += len(part)
            for i, ids in zip(part, self._side_by_side([pieces[i] for i in part])):
                out[i] = ids
        return out

    def _side_by_side(self, pieces: list[bytes]) -> list[bytes]:
        """``pieces`` are not empty and come by falling length, so that those which still have a byte stand in front."""
        if len(self.states) > MOST_STATES or self.used > len(self.slots) // 2:
            self._clear()
        size = np.array([len(p) for p in pieces])
        text, start = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.cumsum(size) - size
        lasts = np.empty((size[0], len(pieces)), np.int64)
        state = np.zeros(len(pieces), np.int64)
        for n in range(size[0]):
            k = np.count_nonzero(size > n)
            found = self.together(state[:k] << 8 | text[start[:k] + n])
            state, lasts[n, :k] = found >> 32, (found & 0xFFFFFFFF) - 1
        row, end, found = np.arange(len(pieces)), size, []
        while len(row):  # from the last token of each piece to its first
            token = lasts[end - 1, row]
            if (token < 0).any():
                raise KeyError("a piece has bytes that are no tokens")
            found.append((row, token))
            end = end - self.sizes[token]
            row, end = row[end > 0], end[end > 0]
        stop = np.cumsum(np.bincount(np.concatenate([r for r, _ in found])))
        ids = np.empty(stop[-1], "<u4")
        for i, (row, token) in enumerate(found, 1):
            ids[stop[row] - i] = token
        raw, at = ids.tobytes(), [0, *(4 * stop).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]


class Decoder:
    """Ids to text, chunk by chunk; an incomplete UTF-8 sequence waits for the next chunk."""

    def __init__(self, vocab: dict[int, bytes], errors: str = "replace"):
        self.vocab, self.utf8 = vocab, codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids, final: bool = False) -> str:
        return self.utf8.decode(b"".join(map(self.vocab.__getitem__, ids)), final)


class Codec:
    """Texts to ids and back: pieces by the pattern, a bounded memo of whole pieces in front of the transducer."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.fst = Transducer(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list) -> list[bytes]:
        """``encode`` of each text; pieces that no memo has are encoded together, those of many texts at once."""
        pieces, ends, found = [], [0], []
        for text in texts:
            pieces += self.split(text or "")
            ends.append(len(pieces))
        for at in range(0, len(pieces), BLOCK):
            block = pieces[at : at + BLOCK]
            if len(self.memo) > MOST_PIECES:  # a full memo becomes the old one, from which pieces that come again are taken over
                self.memo, self.old = {}, self.memo
            memo, old, new = self.memo, self.old, []
            for p in set(block).difference(memo):
                known = old.pop(p, None)
                if known is None:
                    new.append(p)
                else:
                    memo[p] = known
            memo.update(zip(new, self.fst.encode([p.encode("utf-8", "surrogatepass") for p in new])))
            found += map(memo.__getitem__, block)
        return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:])]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.fst.vocab.__getitem__, memoryview(ids).cast("I")))

    def decode_stream(self, ids: bytes, chunk: int = 65_536):
        """Text in chunks by the incremental automaton."""
        d, view = Decoder(self.fst.vocab), memoryview(ids).cast("I")
        for i in range(0, len(view), chunk):
            yield d.feed(view[i : i + chunk])
        yield d.feed((), True)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(path, pattern)


common.kept.append(codec)


def _column(kind: str, values: list) -> pa.Array:
    if kind != "ids":
        return pa.array(values, pa.int64() if kind == "n_tokens" else pa.string())
    ends = np.cumsum([0, *(len(v) // 4 for v in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), "<i4"), pa.int32()))


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokens(docs: DataFrame, carry: list[str], path: str, pattern: str, text: str = "text", want: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``carry`` columns as struct ``row`` and those of ids (array<int>), n_tokens, ids_sha256, decoded (text), decoded_sha256 that ``want`` names.

    Null text is the empty text: no ids. One row per input row, repeated rows alike, empty input gives an empty table.
    The vocabulary file is read by path on each worker; texts are encoded whole, a batch at a time.
    """
    kinds = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}

    @F.arrow_udf("struct<" + ",".join(f"{k}:{kinds[k]}" for k in want) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.tidy(codec)  # earlier stages used the same worker
        for texts in batches:
            for lo in range(0, len(texts), SLICE):  # as Python objects only a slice at a time
                part = texts.slice(lo, SLICE).to_pylist()
                for a, b in common.slices(part):
                    yield encoded(part[a:b])

    def encoded(texts: list) -> pa.StructArray:
        c = codec(path, pattern)
        rows = []
        for ids in c.encode_all(texts):
            row = {"n_tokens": len(ids) // 4}
            if "ids" in want:
                row["ids"] = ids
            if "ids_sha256" in want:
                row["ids_sha256"] = hashlib.sha256(ids).hexdigest()
            if "decoded" in want or "decoded_sha256" in want:
                digest, parts = hashlib.sha256(), []
                for part in c.decode_stream(ids):
                    digest.update(part.encode())
                    parts.append(part if "decoded" in want else "")
                row |= {"decoded": "".join(parts), "decoded_sha256": digest.hexdigest()}
            rows.append(row)
        return pa.StructArray.from_arrays([_column(k, [r[k] for r in rows]) for k in want], names=list(want))

    src = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("text"))
    return src.withColumn("e", run("text")).select("row", "e.*")


def query(spark, sf_dir: str) -> DataFrame:
    df = tokens(common.table(spark, sf_dir, "documents"), ["doc_id"], *public_vocabulary(), want=("n_tokens", "ids_sha256", "decoded_sha256"))
    return df.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of each document, and digests that show the round trip."""
    df = tokens(docs, ["doc_id", "lang", "source"], *public_vocabulary(), want=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    return df.select("row.*", "ids", "n_tokens", "ids_sha256", "decoded_sha256")
