"""Best-fit packing by minimum bin slack.

A document is the ids of a byte-level BPE tokenizer and an end id.  Only one
longer than a window is cut, into full windows, with the remainder as its
first piece.  Windows are filled one after the other: a bitset holds every sum
of available lengths, longest first, that a window can take, the fullest
feasible combination is read back from it and removed.

Pieces are dealt at random into groups of about ``GROUP_PIECES``, each packed
by itself, so that memory and work of a task do not grow with the corpus; a
group leaves room unused in its last windows only.

Null and empty texts are documents of just the end id.  Rows repeated under
one ``doc_id``, or without one, are packed as often as they occur, and pieces
of one length go in the order of document and start.  An empty table has no
pieces.  A very long text is tokenised and cut like any other; other columns of
the input are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._work import flat_bytes, materialize, slices, text_rows

GROUP_PIECES = 50_000
#: Words that one Python worker remembers, about 250 bytes each.
CACHE_WORDS = 800_000
#: Words of more characters are encoded each time they come.
LONG_WORD = 64
#: Bytes of text that are split and numbered together.
SLICE = 1 << 22
#: ASCII letters and marks, and white space beyond ASCII or the start of special tokens.
_LETTER = np.isin(np.arange(256), [*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
_MARK = np.isin(np.arange(256), [*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"])
_UNUSUAL = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|"


class ByteTokenizer:
    """A byte-level BPE tokenizer that encodes every distinct word of a slice of text once.

    A pre-token begins wherever a space follows anything but white space, and
    wherever a mark follows a letter, so ids of a text are those of its parts
    between such places.  Texts with unusual white space or with what may be a
    special token are one part.  Parts are numbered by Arrow; only those in neither generation of the cache
    reach the tokenizer.
    """

    _of_path: dict[str, ByteTokenizer] = {}

    @classmethod
    def get(cls, path: str) -> ByteTokenizer:
        if path not in cls._of_path:
            cls._of_path[path] = cls(path)
        return cls._of_path[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[0] == "Ġ"]] = True  # the sign for a space
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _spaced(self, words: list[str], into: dict[str, bytes]) -> None:
        """Words after one space each: encoded together and cut before each id that begins with a space."""
        for k in range(0, len(words), 256):
            some = words[k : k + 256]
            ids = np.array(self.tok.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) == len(some) and cuts[0] == 0:
                flat, bounds = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                into.update((w, flat[a:b]) for w, a, b in zip(some, bounds[:-1], bounds[1:], strict=True))
            else:
                into.update(zip(some, self._each(some), strict=True))

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct parts, from the cache where it has them."""
        if len(self.young) > CACHE_WORDS // 2:
            self.old, self.young = self.young, {}
        young, old, once = self.young, self.old, {}
        spaced, other, long = [], [], []
        for w in words:
            if w in young:
                continue
            if w in old:
                young[w] = old[w]
            elif len(w) > LONG_WORD:
                long.append(w)
            elif w[0] == " " and w.split() == [w[1:]]:
                spaced.append(w)
            else:
                other.append(w)
        self._spaced(spaced, young)
        young.update(zip(other, self._each(other), strict=True))
        once.update(zip(long, self._each(long), strict=True))
        return [once[w] if len(w) > LONG_WORD else young[w] for w in words]

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each text followed by ``end_id``; and where texts begin."""
        raw, at = flat_bytes(texts)
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = (raw[1:] == 32) & (raw[:-1] > 32) | _MARK[raw[1:]] & _LETTER[raw[:-1]]
        for k in np.flatnonzero(pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)).tolist():
            cut[at[k] : at[k + 1]] = False
        cut[at] = True
        cut[-1] = False
        begin = np.flatnonzero(cut)
        offsets = np.r_[begin, len(raw)].astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = parts.dictionary_encode()
        ids = [*self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.array([end_id], "<u4").tobytes()]
        last = np.searchsorted(begin, at[1:])  # parts before the end of each text
        codes = np.insert(coded.indices.to_numpy(), last, len(ids) - 1)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        length = size[codes]
        stop = np.cumsum(length)
        flat = pool[np.repeat(start[codes] - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)]
        return flat, np.r_[0, stop[last + np.arange(len(texts))]] if len(texts) else np.zeros(1, np.int64)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TYPES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        tok = ByteTokenizer.get(path)
        for b in batches:
            docs = b.column(0).to_pylist()
            for first, count in slices(b.column(1), SLICE):
                ids, bounds = tok.encode(b.column(1).slice(first, count), end_id)
                out: list[list[int]] = [[] for _ in _TYPES]
                for doc, begin, stop in zip(docs[first : first + count], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    rest = (stop - begin) % capacity or capacity
                    for piece, end in enumerate(range(begin + rest, stop + 1, capacity)):
                        at = max(begin, end - capacity)
                        some = ids[at:end]
                        for o, v in zip(out, (doc, piece, at - begin, len(some), zlib.crc32(some)), strict=True):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, _TYPES.values(), strict=True)], names=list(_TYPES))

    return run


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """``(length, copies)`` of a combination with the greatest sum that fits into ``room``.

    ``lengths`` are distinct and descending, ``counts[length]`` is how many
    there are.  Bit ``s`` of the set says whether some of the lengths so far
    add up to ``s``; the set before each step is kept to read the choice back.
    Once ``room`` itself is reached no shorter length can add to it.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        left, some = min(counts[n], room // n), 1
        while left:
            some = min(some, left)
            more = sums | (sums << n * some) & mask
            if more != sums:
                steps.append((n, some, sums))
                sums = more
            left -= some
            some *= 2
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, []
    for n, some, before in reversed(steps):
        if not before >> at & 1:
            out.append((n, some))
            at -= n * some
    return out


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces of equal length go in the order given."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    waiting: dict[int, list[int]] = {}
    for k in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(int(lengths[k]), []).append(k)
    counts = [0] * (capacity + 1)
    for n, those in waiting.items():
        counts[n] = len(those)
    order = sorted(waiting, reverse=True)
    used = 0
    while order:
        longest = order[0]
        # With the longest piece in, so that long ones do not stay behind; where that leaves slack, any combination may do better.
        counts[longest] -= 1
        taken = [(longest, 1), *fullest(order, counts, capacity - longest)]
        counts[longest] += 1
        if sum(n * some for n, some in taken) < capacity:
            other = fullest(order, counts, capacity)
            if sum(n * some for n, some in other) > sum(n * some for n, some in taken):
                taken = other
        at = 0
        for n, some in taken:
            for _ in range(some):
                k = waiting[n].pop()
                window[k], offset[k] = used, at
                at += n
            counts[n] -= some
            if not counts[n] and waiting.pop(n, None) is not None:
                del order[bisect.bisect_left(order, -n, key=lambda x: -x)]
        used += 1
    return window, offset


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = minimum_bin_slack(t["length"].to_numpy(), capacity)
        group = t["grp"].to_numpy()
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array((group << 32) | window)).append_column("offset", pa.array(offset))

    return run


def pack_tightly(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    raw = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
    pieces = materialize(raw.mapInArrow(_pieces(tokenizer_path, end_id, capacity), _PIECES), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack(capacity), f"{_PIECES}, sequence_id long, offset long")
