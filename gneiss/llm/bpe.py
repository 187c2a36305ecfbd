"""BPE encoding and decoding as streams.

Encoding is a transducer over bytes. For each place of the input it keeps the one token that ends
the encoding of what lies before: a vocabulary entry ends there if it stands alone or if it is
compatible with the token that ends where it starts, that is, if the merges leave the pair as it is.
The merge list's lookahead is the length of its longest token: a place is expanded once so many
bytes lie behind it, and all later encodings pass through one of the places that are reached by then.
A token is stable, and is emitted, once their paths share it. What is older than the shared place
is forgotten, so memory doesn't grow with the text. Text is cut into pieces
by the pre-tokenizer's pattern on chunks, where a match is taken only if three more characters follow
it: the pattern looks no further ahead.

Decoding feeds the tokens' bytes through an incremental state machine from bytes to text.

The vocabulary is a file of the public tokenizers library, a parameter; executors read it from
the same installed path. Row-local, no shuffle. A process holds the vocabulary, caches of bounded numbers of entries and a
slice of a batch that is bounded by its text, not by its rows.

Defined results: null text counts as empty (no tokens); repeated rows get equal results; an empty
table gives an empty table; other columns pass through, output columns replace columns of the
same name.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import with_fields
from gneiss.shipping import ship


def byte_of_sign() -> dict[str, int]:
    """The signs that vocabulary files use for bytes: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


def pattern(letter: str, digit: str, space: str) -> str:
    """Fixed: the pre-tokenizer's pattern, over classes of characters given as the insides of brackets."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"


#: For any text, and the same pattern for text within ASCII, which the standard library finds faster.
ANY, ASCII = regex.compile(pattern(r"\p{L}", r"\p{N}", r"\p{White_Space}")), re.compile(pattern("A-Za-z", "0-9", r"\t-\r "))
#: Characters after a match that can still change it.
PATTERN_LOOKAHEAD = 3
#: Entries that a process keeps: some 20 MB of pairs, 20 MB of spines and, in each encoder, 25 MB of words.
CACHED_PAIRS, CACHED_SPINES, CACHED_WORDS = 120_000, 20_000, 120_000


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        signs, model = byte_of_sign(), data["model"]
        raw = {t: bytes(signs[c] for c in t) for t in model["vocab"]}
        self.id_of = {raw[t]: i for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw[a], raw[b]): k for k, (a, b) in enumerate(pairs)}
        #: bytes after a place that decide which tokens start there
        self.lookahead = max(map(len, self.id_of))
        self._begins: set[bytes] | None = None
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._alone: dict[bytes, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        #: token -> its two parts and the rank of the first merge that makes it
        self.made_of: dict[bytes, tuple[bytes, bytes, int]] = {}
        for (a, b), k in self.rank.items():
            self.made_of.setdefault(a + b, (a, b, k))

    @property
    def begins(self) -> set[bytes]:
        """All beginnings of tokens; only long pieces need them."""
        if self._begins is None:
            self._begins = {t[:k] for t in self.id_of for k in range(1, len(t) + 1)}
        return self._begins

    def merged(self, data: bytes) -> list[bytes]:
        """Applies the merges one by one, the first of the lowest rank each time; for short inputs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(x, 1 << 60) for x in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 60:
                break
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def alone(self, token: bytes) -> bool:
        if (known := self._alone.get(token)) is None:
            known = self._alone[token] = self.merged(token) == [token]
        return known

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of a token that ever touch its right (side 1) or left (side 0) edge, from the byte up, each with the rank of the merge that ends it."""
        if (known := self._spines[side].get(token)) is None:
            if len(self._spines[side]) >= CACHED_SPINES:
                self._spines[side].clear()
            out, above = [], 1 << 60
            while True:
                out.append((token, above))
                if token not in self.made_of:
                    break
                a, b, above = self.made_of[token]
                token = b if side else a
            known = self._spines[side][out[0][0]] = out[::-1]
        return known

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether no merge crosses the edge between two tokens.

        Merges come in the order of their ranks, at equal rank from the left. So at the edge the next
        one is a crossing merge of the two parts that touch it, or the merge that ends one of the parts.
        """
        if (known := self._pairs.get((left, right))) is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            x, y, i, j, rank = self.spine(left, 1), self.spine(right, 0), 0, 0, self.rank
            while True:
                (a, end_a), (b, end_b) = x[i], y[j]
                crossing = rank.get((a, b), 1 << 60)
                if crossing < end_a and crossing <= end_b and crossing != 1 << 60:
                    known = False
                    break
                if end_a == end_b == 1 << 60:
                    known = True
                    break
                if end_a <= end_b:
                    i += 1
                else:
                    j += 1
            self._pairs[left, right] = known
        return known


class Transducer:
    """Bytes in, stable token ids out. ``push`` and ``end`` may be called for any number of pieces.

    last[i] is the token that ends the encoding of data[:i]. Places are expanded in order, each once
    the vocabulary's lookahead lies behind it: every token that starts there is tried forward.
    ``whole`` is the shortcut for a piece that is at hand to its end.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.data, self.last, self.at = b"", [None], 0

    def _expand(self, to: int) -> None:
        id_of, begins, data, last, pairs = self.v.id_of, self.v.begins, self.data, self.last, self.v._pairs
        compatible, n = self.v.compatible, len(self.data)
        last += [None] * (n + 1 - len(last))
        for start in range(self.at, to):
            before = last[start]
            for end in range(start + 1, n + 1):
                token = data[start:end]
                if token not in begins:
                    break
                if token in id_of:
                    if before is None:
                        ok = self.v.alone(token)
                    elif (ok := pairs.get((before, token))) is None:
                        ok = compatible(before, token)
                    if ok:
                        last[end] = token
        self.at = max(self.at, to)

    def push(self, more: bytes) -> list[int]:
        """Takes bytes; gives the ids that no later byte can change."""
        self.data += more
        self._expand(max(self.at, len(self.data) - self.v.lookahead))
        return self._stable() if self.at > 2 * self.v.lookahead else []

    def whole(self, data: bytes) -> list[int]:
        """Ids of a short piece: from each place the longest token that fits goes first.

        The encoding of what lies before a place is one and the same on every way to it, so a place from
        which the end wasn't reached is never tried again, and each place is expanded at most once.
        """
        v = self.v
        id_of, pairs, n, lookahead = v.id_of, v._pairs, len(data), v.lookahead
        path, dead, before, start, end = [], set(), None, 0, min(n, v.lookahead)
        while start < n:
            while end > start:
                token = data[start:end]
                if token in id_of and end not in dead:
                    if before is None:
                        ok = v.alone(token)
                    elif (ok := pairs.get((before, token))) is None:
                        ok = v.compatible(before, token)
                    if ok:
                        break
                end -= 1
            if end > start:
                path.append(token)
                before, start = token, end
                end = min(n, start + lookahead)
            else:
                dead.add(start)
                end = start - 1
                start -= len(path.pop())
                before = path[-1] if path else None
        return [id_of[t] for t in path]

    def _path(self, end: int) -> list[int]:
        places, last = [end], self.last
        while end > 0:
            end -= len(last[end])
            places.append(end)
        return places

    def _cut(self, to: int) -> list[int]:
        places, data, id_of = self._path(to)[::-1], self.data, self.v.id_of
        ids = [id_of[data[a:b]] for a, b in zip(places, places[1:], strict=False)]
        if to < len(data):
            self.data, self.last, self.at = data[to:], self.last[to:], self.at - to
        return ids

    def _stable(self) -> list[int]:
        """Later encodings start a token at an expanded place or one of the lookahead after it that is reached."""
        live = [e for e in range(self.at, len(self.last)) if self.last[e] is not None]
        if not live:
            return []
        shared = set(self._path(live[0]))
        for e in live[1:]:
            # two paths that meet stay together, so the first common place is enough
            place = e
            while place not in shared:
                place -= len(self.last[place])
            shared = {x for x in shared if x <= place}
        to = max(shared)
        return self._cut(to) if 0 < to <= self.at else []

    def end(self) -> list[int]:
        """The rest of the piece; the next one starts afresh."""
        self._expand(len(self.data))
        ids = self._cut(len(self.data))
        self._clear()
        return ids


class Encoder:
    """Text to ids, packed as little-endian unsigned 32-bit integers, chunk by chunk."""

    def __init__(self, vocabulary: Vocabulary, chunk: int = 1 << 16, cache_words: int = CACHED_WORDS):
        self.v, self.chunk, self.cache_words = vocabulary, chunk, cache_words
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        #: words met lately, and those met before them
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.transducer = Transducer(vocabulary)

    def word(self, piece: str) -> bytes:
        """Packed ids of a piece that the cache of late words doesn't have."""
        if (packed := self.older.get(piece)) is None:
            packed = self.made(piece)
        if len(piece) <= 64:
            if len(self.cache) >= self.cache_words:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = packed
        return packed

    def made(self, piece: str) -> bytes:
        t = self.transducer
        data, step, ids = piece.encode("utf-8", "surrogatepass"), 4096, []
        if len(data) <= 256:
            ids = t.whole(data)
        else:
            for k in range(0, len(data), step):
                ids += t.push(data[k : k + step])
            ids += t.end()
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> Iterator[bytes]:
        """Packed ids of text without special tokens."""
        at, size = 0, self.chunk
        while at < len(text):
            part = text[at : at + size]
            pieces = (ASCII if part.isascii() else ANY).findall(part)
            if at + size < len(text):
                # pieces cover the chunk; those too near to its end wait
                end = len(part)
                while pieces and end + PATTERN_LOOKAHEAD > len(part):
                    end -= len(pieces.pop())
                if not pieces:
                    size *= 2
                    continue
                at += end
            else:
                at = len(text)
            size, get = self.chunk, self.cache.get
            yield b"".join([x if (x := get(w)) is not None else self.word(w) for w in pieces])

    def encode(self, text: str | None) -> Iterator[bytes]:
        if not text:
            return
        for part in self.split.split(text) if self.split else [text]:
            if part in self.v.special:
                yield np.array([self.v.special[part]], "<u4").tobytes()
            elif part:
                yield from self.plain(part)


def decode(vocabulary: Vocabulary, packed: Iterable[bytes]) -> Iterator[str]:
    """Text of packed ids, piece by piece; bytes of a character may lie in several pieces."""
    machine, token = codecs.getincrementaldecoder("utf-8")("replace"), vocabulary.bytes_of
    for p in packed:
        yield machine.decode(b"".join([token[i] for i in np.frombuffer(p, "<u4").tolist()]))
    yield machine.decode(b"", True)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One copy a process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Characters of text that one slice of a batch holds at most, beyond its first row.
SLICE = 1 << 20


def slices(batch: pa.Array) -> Iterator[list[str | None]]:
    """The rows of a batch, a bounded amount of text at a time."""
    size = np.asarray(pc.fill_null(pc.utf8_length(batch), 0), np.int64)
    part = (np.cumsum(size) - size) // SLICE
    for k in np.unique(part):
        at = np.nonzero(part == k)[0]
        yield batch.slice(at[0], len(at)).to_pylist()


def encoded(encoder: Encoder, text: str | None, keep: bool) -> tuple[bytes, int, str, str]:
    """(packed ids if they are kept, their number, digest of the ids, digest of the text decoded from them).

    One pass: each chunk's ids go straight on to the decoder.
    """
    out, ids, said, n = [], hashlib.sha256(), hashlib.sha256(), 0

    def seen() -> Iterator[bytes]:
        nonlocal n
        for p in encoder.encode(text):
            ids.update(p)
            n += len(p) // 4
            if keep:
                out.append(p)
            yield p

    for piece in decode(encoder.v, seen()):
        said.update(piece.encode("utf-8", "surrogatepass"))
    return b"".join(out), n, ids.hexdigest(), said.hexdigest()


def lists(packed: list[bytes]) -> pa.Array:
    """array<int> of packed ids."""
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def bpe_encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids (array<int>) and decoded_sha256: the digest of the text that the ids decode to."""
    ship(docs.sparkSession)

    @F.arrow_udf("ids array<int>, n_tokens bigint, decoded_sha256 string")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary(path))
        for b in batches:
            for rows in slices(b):
                done = [encoded(encoder, t, True) for t in rows]
                yield pa.StructArray.from_arrays([lists([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64()), pa.array([x[3] for x in done], pa.string())], ["ids", "n_tokens", "decoded_sha256"])

    return with_fields(docs, tokens(F.col(text)), ("n_tokens", "ids", "decoded_sha256"))


def bpe_decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of their ids; null ids count as none."""
    ship(tokens.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for b in batches:
            yield pd.Series(["" if x is None else "".join(decode(v, [np.asarray(x, "<u4").tobytes()])) for x in b], dtype=object)

    return tokens.withColumn(out, text(F.col(ids)))


def bpe_digest(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: one pass encodes and decodes each chunk, and nothing but digests is kept."""
    ship(docs.sparkSession)

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary(path))
        for b in batches:
            for rows in slices(b):
                done = [encoded(encoder, t, False)[1:] for t in rows]
                yield pa.StructArray.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*done), (pa.int64(), pa.string(), pa.string()))], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return with_fields(docs, digests(F.col(text)), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_bpe(documents: DataFrame) -> DataFrame:
    return bpe_digest(documents.select("doc_id", "text"), default_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
