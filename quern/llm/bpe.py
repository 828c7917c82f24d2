"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regex. Code points map to a few classes by one table lookup; each
class is a transition function of a small automaton, and the functions form a finite monoid whose
product table is computed once. The state before every code point then is an associative scan over
one-byte monoid elements, done in blocks for whole chunks of texts at once; texts are kept apart by
an element that resets. Boundaries follow from state, class and two code points of look-ahead, and
slice the text into pieces. A long text is taken in segments: pieces match the same from any true
boundary on, so what follows a segment's last sure boundary is read again with the next segment.
Pieces go through a bounded cache to pair merging by rank.

The vocabulary is one string of bytes with an offset for each id. Decoding gathers ids by these
offsets, and the running sum of their lengths tells where each token lies in the text (token_spans).

Memory follows the longest text only by the text itself and the longest piece; ids and decoded
bytes of the query are hashed segment by segment.

Edge cases: null and empty texts have no tokens; rows that repeat are encoded each; null ids pass
through; an empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.arrow import text_chunks, texts_of
from quern.llm.common import table

RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Bytes of text that are scanned at a time. What is decided at a code point depends on fewer than LOOK_AHEAD behind it.
SEGMENT, LOOK_AHEAD = 1 << 20, 4

# Classes of code points. Those from APOSTROPHE on matter to the contractions 's 't 're 've 'm 'll 'd.
LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE, ENDS, R, V, E, L = range(11)
RESET = 11
N_CLASSES = 12
IS_LETTER = np.array([c in (LETTER, ENDS, R, V, E, L) for c in range(N_CLASSES)])
IS_NUMBER = np.array([c == NUMBER for c in range(N_CLASSES)])
IS_OTHER = np.array([c in (OTHER, APOSTROPHE) for c in range(N_CLASSES)])
IS_BLANK = np.array([c in (SPACE, BLANK) for c in range(N_CLASSES)])

# States: what the last code point was part of. FRESH: a text's start or just after a contraction.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, AFTER_MARK, MARK_R, MARK_V, MARK_L = range(10)
N_STATES = 10


def _next_state(state: int, cls: int) -> int:
    if cls == RESET:
        return FRESH
    if cls == SPACE:
        return AFTER_SPACE
    if cls == BLANK:
        return IN_BLANKS
    if cls == NUMBER:
        return IN_NUMBERS
    if cls == OTHER:
        return IN_OTHERS
    if cls == APOSTROPHE:
        return IN_OTHERS if state in (IN_OTHERS, AFTER_SPACE, AFTER_MARK) else AFTER_MARK
    if state == AFTER_MARK:
        return {ENDS: FRESH, R: MARK_R, V: MARK_V, L: MARK_L}.get(cls, IN_LETTERS)
    if (state, cls) in ((MARK_R, E), (MARK_V, E), (MARK_L, L)):
        return FRESH
    return IN_LETTERS


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class, flat product table (first then second), state that each element leads to from FRESH."""
    functions = [tuple(range(N_STATES))]
    index = {functions[0]: 0}
    generators = [tuple(_next_state(s, c) for s in range(N_STATES)) for c in range(N_CLASSES)]
    at = 0
    while at < len(functions):
        for g in generators:
            product = tuple(g[s] for s in functions[at])
            if product not in index:
                index[product] = len(functions)
                functions.append(product)
        at += 1
    if len(functions) > 256:
        raise AssertionError("monoid elements have to fit a byte")
    table_ = np.zeros((256, 256), np.uint8)
    for a, f in enumerate(functions):
        for b, g in enumerate(functions):
            table_[a, b] = index[tuple(g[s] for s in f)]
    from_fresh = np.zeros(256, np.uint8)
    from_fresh[: len(functions)] = [f[FRESH] for f in functions]
    return np.array([index[g] for g in generators], np.uint8), table_.ravel(), from_fresh


def scan(elements: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive products of monoid elements: blocks side by side, then the blocks' totals, then both together."""
    product = monoid()[1]
    n = len(elements)
    if n <= block:
        out, so_far = np.empty(n, np.uint8), 0
        for i, x in enumerate(elements.tolist()):
            out[i] = so_far = int(product[(so_far << 8) | x])
        return out
    rows = -(-n // block)
    padded = np.zeros(rows * block, np.uint8)
    padded[:n] = elements
    grid = np.ascontiguousarray(padded.reshape(rows, block).T)
    for j in range(1, block):
        grid[j] = product[(grid[j - 1].astype(np.uint16) << 8) | grid[j]]
    before = np.zeros(rows, np.uint8)
    before[1:] = scan(grid[-1], block)[:-1]
    shifted = before.astype(np.uint16) << 8
    for j in range(block):
        grid[j] = product[shifted | grid[j]]
    return grid.T.reshape(-1)[:n]


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point. Letters, numbers and white space are asked of the tiktoken library, whose properties decide."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def members(kind: str) -> np.ndarray:
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        return np.frombuffer(probe.decode(probe.encode_ordinary(every)).encode("utf-32-le"), "<u4")

    classes = np.full(0x110000, OTHER, np.uint8)
    classes[members(r"\p{L}")] = LETTER
    classes[members(r"\p{N}")] = NUMBER
    classes[members(r"\s")] = BLANK
    for marks, cls in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", ENDS), ("r", R), ("v", V), ("e", E), ("l", L)):
        classes[[ord(x) for x in marks]] = cls
    return classes


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin. codes: the code points of texts end to end; starts: where each non-empty text begins."""
    n = len(codes)
    cls = class_table()[codes]
    of_class, product, from_fresh = monoid()
    elements = of_class[cls]
    elements[starts] = product[(np.uint16(of_class[RESET]) << 8) | elements[starts].astype(np.uint16)]
    after = from_fresh[scan(elements)]
    before = np.empty(n, np.uint8)
    before[0] = FRESH
    before[1:] = after[:-1]
    before[starts] = FRESH
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    follows = ~first[1:]  # whether the next code point belongs to the same text
    letter, number, other, blank = IS_LETTER[cls], IS_NUMBER[cls], IS_OTHER[cls], IS_BLANK[cls]
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = ~blank[1:]
    next_solid &= follows
    completes = np.zeros(n, bool)  # the next code point ends a two-letter contraction
    completes[:-1] = after[1:] == FRESH
    completes &= follows & (after >= MARK_R)
    in_blanks = (before == AFTER_SPACE) | (before == IN_BLANKS)
    in_letters = (before == IN_LETTERS) | (before >= MARK_R)
    same = (in_letters & letter) | ((before == IN_NUMBERS) & number) | ((before == IN_OTHERS) & other)
    same |= (before == AFTER_MARK) & (other | (letter & ((after == FRESH) | completes)))
    same |= before == AFTER_SPACE
    same &= before != FRESH
    return np.where(blank, ~in_blanks | next_solid | (before == FRESH), ~same)


class BpeCodec:
    """Encodes texts piece by piece, decodes ids by offsets into the vocabulary's bytes."""

    #: Bounds of the piece cache: entries, and bytes of a piece that enters it. They don't change results.
    CACHE_ENTRIES, CACHE_PIECE = 400_000, 64

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        words = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            words[rank] = token
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in words])])
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.pair_ranks = np.full(1 << 16, -1, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pair_ranks[token[0] << 8 | token[1]] = rank
        codec = self

        class Cache(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = np.array(codec.merge(piece.encode()), "<u4").tobytes()
                if len(piece) <= codec.CACHE_PIECE:
                    if len(self) >= codec.CACHE_ENTRIES:
                        self.clear()
                    self[piece] = ids
                return ids

        self.cache = Cache()

    def merge(self, piece: bytes) -> list[int]:
        """Join neighbouring parts, lowest rank first, leftmost of equals first."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 128:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts[:-1], parts[1:], strict=True)]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        return [ranks[x] for x in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a queue of pairs, for pieces where scanning all pairs again costs. Parts are kept as sizes at their starts.

        The first pairs are one sorted array, only pairs that merging makes go to a heap, so a piece
        of many megabytes takes some tens of bytes for each of its bytes.
        """
        n, ranks = len(piece), self.ranks
        data = np.frombuffer(piece, np.uint8)
        pairs = self.pair_ranks[(data[:-1].astype(np.int32) << 8) | data[1:]]
        places = np.flatnonzero(pairs >= 0)
        first = np.sort((pairs[places] << 32) | places)
        size, before = array("i", [1]) * n, array("i", range(-1, n - 1))
        heap: list[int] = []
        for own in _listed(first):
            while True:
                entry = heappop(heap) if heap and heap[0] < own else own
                if entry == _END:
                    break
                i = entry & 0xFFFFFFFF
                j = i + size[i]
                if size[i] and j < n and ranks.get(piece[i : j + size[j]]) == entry >> 32:
                    size[i] += size[j]
                    size[j] = 0
                    after, left = i + size[i], before[i]
                    if after < n:
                        before[after] = i
                        if (wider := ranks.get(piece[i : after + size[after]])) is not None:
                            heappush(heap, wider << 32 | i)
                    if left >= 0 and (wider := ranks.get(piece[left:after])) is not None:
                        heappush(heap, wider << 32 | left)
                if entry == own:
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : i + size[i]]])
            i += size[i]
        return out

    def pieces(self, texts: list[str]) -> Iterator[list[str]]:
        """The pieces of each text, by one scan over all."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        cuts = np.flatnonzero(boundaries(codes, starts[ends > starts])) if len(codes) else np.zeros(0, np.int64)
        low, high = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
        for text, base, i, j in zip(texts, starts.tolist(), low.tolist(), high.tolist(), strict=True):
            own = (cuts[i:j] - base).tolist()
            yield [text[a:b] for a, b in zip(own, [*own[1:], len(text)], strict=True)] if own else []

    def long_pieces(self, text: bytes, segment: int = SEGMENT) -> Iterator[list[str]]:
        """The pieces of one text, segment by segment."""
        at, rest, size = 0, "", segment
        while at < len(text):
            end = min(at + size, len(text))
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            rest += text[at:end].decode()
            at = end
            if at == len(text):
                yield from self.pieces([rest])
                return
            cuts = np.flatnonzero(boundaries(np.frombuffer(rest.encode("utf-32-le"), "<u4"), np.zeros(1, np.int64)))
            cuts = cuts[cuts <= len(rest) - LOOK_AHEAD]
            own = cuts.tolist()
            if len(own) > 1:
                yield [rest[a:b] for a, b in zip(own, own[1:])]
                rest, size = rest[own[-1] :], segment
            else:
                size *= 2  # one piece so far: read on in growing steps

    def encode_parts(self, texts: list[bytes], segment: int = SEGMENT) -> Iterator[Iterator[bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, part by part; to be taken in order."""
        look_up = self.cache.__getitem__
        for first, last in _together([len(t) for t in texts], segment):
            if last - first == 1 and len(texts[first]) > segment:
                yield (b"".join(map(look_up, own)) for own in self.long_pieces(texts[first], segment))
            else:
                for own in self.pieces([t.decode() for t in texts[first:last]]):
                    yield iter([b"".join(map(look_up, own))])

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for parts in self.encode_parts([t.encode() for t in texts]):
            yield b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, gathered from the vocabulary by offset."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        first = self.offsets[at]
        sizes = self.offsets[at + 1] - first
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.bytes[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def token_spans(self, ids: bytes) -> np.ndarray:
        """Where each token begins in the decoded bytes, and their end."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        return np.concatenate([[0], np.cumsum(self.offsets[at + 1] - self.offsets[at])])


_END = 1 << 62


def _listed(entries: np.ndarray) -> Iterator[int]:
    """The entries as Python numbers, some at a time, then _END."""
    for start in range(0, len(entries), 1 << 16):
        yield from entries[start : start + (1 << 16)].tolist()
    yield _END


def _together(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """First and end of runs of texts that have limit bytes together at most; a longer text is a run of its own."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > limit:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


@lru_cache(2)
def codec(ranks_path: str) -> BpeCodec:
    return BpeCodec(ranks_path)


def ranks_path(name: str = RANKS_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int): the tokens of every text."""
    path = path or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for chunk in text_chunks(batches):
            ids = [np.frombuffer(b"".join(parts), "<u4").view(np.int32) for parts in bpe.encode_parts(texts_of(chunk))]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes it again."""
    path = path or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for chunk in text_chunks(batches):
            counts, encoded, decoded = [], [], []
            for parts in bpe.encode_parts(texts_of(chunk)):
                count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for ids in parts:
                    count += len(ids) // 4
                    of_ids.update(ids)
                    of_bytes.update(bpe.decode(ids))
                counts.append(count)
                encoded.append(of_ids.hexdigest())
                decoded.append(of_bytes.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
