"""Vector bin packing of tokenised examples into training sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.
Examples of a full sequence or more are cut into full sequences first; what
remains of them and shorter ones are placed by the dot-product heuristic
(Panigrahy et al., "Heuristics for Vector Bin Packing", 2011): into the open
sequence goes the example that fits and whose demand vector (tokens, segments,
loss-bearing tokens) has the largest product with the room left, all as shares of the limits.
When none fits whole, the example that fills most of the room is cut, its prompt and its response
in proportion. A sequence that a limit keeps from being full and the last one of a window
are split into sequences of power-of-two sizes, which need no padding.

Each task packs the rows it reads in windows of WINDOW examples, so nothing is
shuffled and memory is bounded. Sequence numbers hold the task's number above
the task's own count, and so are the same when a task runs again.

Defined cases: a null text is empty, and every document has its end token, so none
is without a piece. Repeated rows are packed once each. An empty table
gives no pieces. Null ids stay null. Extra columns aren't read, so they can't clash.
"""

from __future__ import annotations

import codecs
import itertools
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.shared import table

TOKENS, SEGMENTS, LOSS, WINDOW = 2048, 64, 1740, 4096
#: Shares of an example's tokens, its last ones, that bear loss: the others stand for its prompt. Documents have no roles, so the crc32 of the id picks one.
LOSS_SHARES = (0.3, 0.5, 0.7, 0.9)
VOCABULARY, END = "word_bpe_49k.json", 1
CACHED_PARTS = 150_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_segments long"


#: The pre-tokenizer's pattern in the vocabulary's file.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: White space, printable ASCII and the letters from U+00C0 to U+00FF, in UTF-8: single code points in any normal form, each with one lower case.
_SPACES = b" \t\n\v\f\r"
_PLAIN = _SPACES + bytes(range(33, 127)) + b"\xc3" + bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))
_SPACE = re.compile(rb"[ \t-\r]")
_ODD = bytes(b not in _PLAIN for b in range(256))
#: Bytes of plain words in lower case, and their kinds: a run of letters is a part, each digit is one, and so is a run of others.
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b < 0x9F else b for b in range(256))
_KINDS = bytes(0 if b in _SPACES else 1 if b >= 128 or 97 <= b | 32 <= 122 else 2 if 48 <= b <= 57 else 3 for b in range(256))
_BLOCK = 1 << 21
#: Byte-level models write a byte that isn't printable as the next character from U+0100 on.
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
_LETTERS = "".join(chr(_BYTE_LETTERS.get(b, b)) for b in range(256))


class WordTokenizer:
    """Ids of texts in UTF-8, as little-endian unsigned 32-bit bytes.

    For vocabularies that split at white space and drop it, a text's ids are its words' ids. Texts are split whole blocks at once,
    and each distinct part is tokenised once while it stays in the cache. Where the vocabulary splits words by _SPLIT, parts of words
    of _PLAIN bytes are what it makes of them, and go to the library's model directly. Other words and those with
    special tokens are parts as they are, and go to the library.
    The cache has two generations of CACHED_PARTS parts at most; the older one is
    dropped, less what was used again, when the younger one is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._model = self._tokenizer.model
        said = json.loads(self._tokenizer.to_str())
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        special = [t["content"].encode() for t in said.get("added_tokens") or []]
        self._special = re.compile(b"|".join(map(re.escape, special)) or rb"(?!)")
        #: A special token of several kinds of characters lies in no part.
        self._by_parts = steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and all(len(set(t.translate(_KINDS))) > 1 and b"'" not in t for t in special)

    def _split(self, data: bytes) -> tuple[np.ndarray, pa.Array]:
        """A block's parts, and where each begins in it."""
        data += b"   "
        low = data.translate(_LOWER)
        chars, kinds = np.frombuffer(low, dtype=np.uint8), np.frombuffer(low.translate(_KINDS), dtype=np.uint8)
        begins = np.empty(len(chars), dtype=bool)
        begins[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
        begins |= kinds == 2
        if b"'" in low:
            quotes = np.flatnonzero(chars == 39)
            quotes = quotes[begins[quotes] & (kinds[quotes + 1] == 1)]
            one, two = chars[quotes + 1], chars[quotes + 2]
            long = (two == 101) & ((one == 114) | (one == 118)) | (two == 108) & (one == 108)
            for size, those in ((2, quotes[np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))]), (3, quotes[long])):
                begins[those + 1] = False
                begins[those + size] = True
        if not self._by_parts or data.translate(None, _PLAIN) or self._special.search(data):
            edges = np.flatnonzero(np.diff(kinds != 0, prepend=False))
            words, ends = edges[::2], edges[1::2]
            if self._by_parts:
                at = np.concatenate([np.flatnonzero(np.frombuffer(data.translate(_ODD), dtype=np.uint8)), np.array([m.start() for m in self._special.finditer(data)], dtype=np.int64)])
                odd = np.unique(np.searchsorted(words, at, side="right") - 1)
                words, ends = words[odd], ends[odd]
            step = np.zeros(len(chars), dtype=np.int8)
            step[words], step[ends] = 1, -1
            inside = np.cumsum(step, dtype=np.int8) > 0
            begins[inside] = False
            begins[words] = True
            low = np.where(inside, np.frombuffer(data, dtype=np.uint8), chars).tobytes()
        at = np.flatnonzero(begins)
        lengths, words = np.diff(at, append=len(chars)), kinds[at] != 0
        offsets = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths[words])])
        return at[words], pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low.translate(None, _SPACES))])

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        out = list(map(self._young.get, parts))
        others = []
        for k in [k for k, v in enumerate(out) if v is None]:
            part = parts[k]
            ids = self._old.get(part)
            if ids is None:
                if not self._by_parts or part.translate(None, _PLAIN) or self._special.search(part):
                    others.append(k)
                    continue
                ids = _le(array("I", [t.id for t in self._model.tokenize(codecs.charmap_decode(part, "strict", _LETTERS)[0])]))
            self._young[part] = out[k] = ids
        for at in range(0, len(others), 20_000):
            some = others[at : at + 20_000]
            coded = self._tokenizer.encode_batch_fast([parts[k].decode("utf-8", "replace") for k in some], add_special_tokens=False)
            for k, c in zip(some, coded, strict=True):
                self._young[parts[k]] = out[k] = _le(array("I", c.ids))
        if len(self._young) > CACHED_PARTS:
            self._young, self._old = {}, self._young
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        data = b" ".join(texts)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        before = np.zeros(len(bounds), dtype=np.int64)
        out, at, size = [], 0, 0
        while at < len(data):
            cut = _SPACE.search(data, at + _BLOCK)
            to = cut.start() if cut else len(data)
            begin, parts = self._split(data[at:to])
            ends = np.zeros(1, dtype=np.int64)
            if len(begin):
                coded = parts.dictionary_encode()
                ids = pa.array(self._ids(coded.dictionary.to_pylist()), type=pa.large_binary()).take(coded.indices)
                ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[: len(begin) + 1]
                out.append(ids.buffers()[2][: int(ends[-1])])
            first, last = np.searchsorted(bounds, [at, to])
            before[first:last] = size + ends[np.searchsorted(begin, bounds[first:last] - at)]
            at, size = to, size + int(ends[-1])
        before[np.searchsorted(bounds, at) :] = size
        flat = b"".join(out)
        return [flat[x:y] for x, y in itertools.pairwise(before.tolist())]


def _le(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The process's tokenizer; its cache serves all tasks that the worker runs, until it runs another operator's."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
        kernels.CACHES.append(_tokenizers.clear)
    return _tokenizers[path]


def place(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (example, start, length) of one window of examples.

    loss: how many of an example's tokens bear loss; they are its last ones. Examples without tokens have no piece.
    An example that is cut gives the end of what is left of its prompt and the beginning of what is left of its response, so
    that both parts keep their proportion; a piece of both is one segment while they lie side by side.
    """
    size, segments, most_loss = limits
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    done: list[list[tuple[int, int, int]]] = []
    tokens = tokens.astype(np.int64)
    bears = np.minimum(loss, tokens).astype(np.int64)
    #: What is left of an example: head tokens without loss that end at head_end, tail tokens with loss from tail_at on.
    head, tail, head_end, tail_at = tokens - bears, bears.copy(), tokens - bears, tokens - bears

    def cut(i: int, room: int, room_loss: int, room_segments: int) -> tuple[int, int]:
        """How many tokens of head and tail go into the room."""
        h, t = int(head[i]), int(tail[i])
        most_t, x = min(t, room_loss), min(room, h + t)
        y = min(max(-(-x * t // (h + t)), x - h), most_t)
        take = min(h, x - y), y
        if all(take) and room_segments < 2 and head_end[i] != tail_at[i]:
            take = (min(h, room), 0) if min(h, room) > min(most_t, room) else (0, min(most_t, room))
        return take

    def pieces(i: int, h: int, t: int) -> list[tuple[int, int, int]]:
        e, s = int(head_end[i]), int(tail_at[i])
        head[i], tail[i], head_end[i], tail_at[i] = head[i] - h, tail[i] - t, e - h, s + t
        if h and t and e == s:
            return [(i, e - h, h + t)]
        return [(i, at, n) for at, n in ((e - h, h), (s, t)) if n]

    for i in np.flatnonzero(tokens >= size).tolist():
        while head[i] + tail[i] >= size and sum(take := cut(i, size, most_loss, segments)) == size:
            done.append(pieces(i, *take))
    ids = np.flatnonzero(head + tail > 0)
    live, remaining = np.ones(len(ids), dtype=bool), len(ids)
    h, t = head[ids], tail[ids]
    parts = 1 + ((h > 0) & (t > 0) & (head_end[ids] != tail_at[ids]))
    bin_: list[tuple[int, int, int]] = []
    room, room_loss = size, most_loss
    while remaining:
        free = segments - len(bin_)
        whole = h + t
        fits = live & (whole <= room) & (t <= room_loss) & (parts <= free)
        worth = np.where(fits, whole * (room / size**2) + t * (room_loss / most_loss**2) + parts * (free / segments**2), -1.0)
        k = int(worth.argmax())
        if worth[k] >= 0 and (free > parts[k] or whole[k] == room):
            take = int(h[k]), int(t[k])
        else:
            # None fits whole, or the last segment would leave room: the example that fills most of it is cut, of equal ones the longest.
            k = int(np.where(live, np.minimum(room, h + np.minimum(t, room_loss)) * (whole.max() + 1) + whole, -1).argmax())
            take = cut(int(ids[k]), room, room_loss, free)
        if sum(take):
            i = int(ids[k])
            bin_ += pieces(i, *take)
            room, room_loss = room - sum(take), room_loss - take[1]
            h[k], t[k] = head[i], tail[i]
            parts[k] = 1 + int(h[k] > 0 and t[k] > 0 and head_end[i] != tail_at[i])
            if not h[k] + t[k]:
                live[k] = False
                remaining -= 1
                if remaining > 64 and remaining * 2 < len(ids):
                    h, t, parts, ids = h[live], t[live], parts[live], ids[live]
                    live = np.ones(len(ids), dtype=bool)
        if not room or len(bin_) >= segments or not sum(take):
            done += _powers_of_two(bin_) if room else [bin_]
            bin_, room, room_loss = [], size, most_loss
    if bin_:
        done += _powers_of_two(bin_)
    return done


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a sequence as sequences of descending power-of-two sizes."""
    out, total = [], sum(n for _, _, n in pieces)
    rest = list(pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        part = []
        while size:
            i, s, n = rest[0]
            take = min(n, size)
            part.append((i, s, take))
            size -= take
            rest[0] = (i, s + take, n - take)
            if take == n:
                rest.pop(0)
        out.append(part)
    return out


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), loss_share: Column | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """PIECES of every row's tokens and end token. loss_share: the share of an example's tokens, its last ones, that bear loss (null: all); one of LOSS_SHARES by default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        task = TaskContext.get().partitionId() << 40
        count = 0
        end_id = np.array([end], dtype="<u4").tobytes()

        def packed(ids: list, tokens: list[bytes], shares: list[float]) -> pa.RecordBatch:
            nonlocal count
            n = np.array([len(t) // 4 for t in tokens], dtype=np.int64)
            cols: list[list] = [[] for _ in range(8)]
            for pieces in place(n, np.ceil(n * np.array(shares)).astype(np.int64), limits):
                offset = 0
                for i, start, length in pieces:
                    for col, v in zip(cols, (ids[i], start, length, zlib.crc32(tokens[i][4 * start : 4 * (start + length)]), int(n[i]), task + count, offset, len(pieces)), strict=True):
                        col.append(v)
                    offset += length
                count += 1
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], [f.split()[0] for f in PIECES.split(", ")])

        ids: list = []
        tokens: list[bytes] = []
        shares: list[float] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids += part.column(0).to_pylist()
                shares += part.column(2).to_pylist()
                new = [t + end_id for t in tokenizer([(t or "").encode() for t in part.column(1).to_pylist()])]
                tokens += new
                size += sum(map(len, new))
                if len(ids) >= window or size > 1 << 24:
                    yield packed(ids, tokens, shares)
                    ids, tokens, shares, size = [], [], [], 0
        if ids:
            yield packed(ids, tokens, shares)
        #: Arrow's pool keeps what is freed, and a worker that waits for its next task would hold it.
        ids, tokens, shares = [], [], []
        pa.default_memory_pool().release_unused()

    if loss_share is None:
        of = F.crc32(F.col(id_col).cast("long").cast("string")) % len(LOSS_SHARES)
        loss_share = F.element_at(F.array(*map(F.lit, LOSS_SHARES)), (F.coalesce(of, F.lit(0)) + 1).cast("int"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(loss_share.cast("double"), F.lit(1.0))))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), share.alias("share"))
    return rows.mapInArrow(run, PIECES)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of every document."""
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left; the pipeline's last stage."""
    return pack(docs, vocabulary_path())
