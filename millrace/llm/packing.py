"""Packing of tokenised documents into fixed-length training sequences.

Best-fit decreasing: documents longer than a window are first cut into full
windows, then pieces are placed longest first, each into the open window with
the least sufficient room.  A segment tree over remaining capacities finds
that window in ``log2(capacity)`` steps.  Pieces are dealt at random into
groups of about ``GROUP_PIECES`` and every group is packed by itself, so a
task's work and memory do not grow with the corpus; with that many pieces a
group already leaves next to no room unused.

Null and empty texts are documents of just the end id.  Rows repeated under
one ``doc_id`` are packed as often as they occur.  A very long text is
tokenised in one run and cut like any other; an empty table has no pieces; other
columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._work import materialize, slices, text_rows

GROUP_PIECES = 50_000
#: Words that one Python worker remembers, about 250 bytes each.
CACHE_WORDS = 800_000
#: Bytes of text that are split and numbered together.
SLICE = 1 << 22
_TAIL = ".,!;:?"
_LATIN = "\u024f"


class WordTokenizer:
    """A word-end BPE tokenizer that encodes every distinct word of a slice of text once.

    The vocabulary's pre-tokeniser never joins characters across ASCII white
    space and drops the space, so a text's ids are its words' ids in order.
    Words are split and numbered by Arrow; only words in neither generation of
    the cache reach the tokenizer.  A new word enters the young generation and
    a word met again returns to it; when the young one is full the old one is
    dropped, so frequent words stay however many rare ones pass, in bounded
    memory.
    """

    _of_path: dict[str, WordTokenizer] = {}

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        if path not in cls._of_path:
            cls._of_path[path] = cls(path)
        return cls._of_path[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        """Ids of words of any kind, told apart by encoding each by itself."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str], into: dict[str, bytes]) -> None:
        """Words of letters only, one pre-token each: encoded together and cut after each word-end id."""
        for k in range(0, len(words), 4000):
            some = words[k : k + 4000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(some) and stops[-1] == 4 * len(ids):
                flat, at = ids.tobytes(), 0
                for w, stop in zip(some, stops.tolist(), strict=True):
                    into[w] = flat[at:stop]
                    at = stop
            else:  # a letter whose normal form is not one
                into.update(zip(some, self._each(some), strict=True))

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the cache where it has them."""
        if len(self.young) > CACHE_WORDS // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        tails, letters, other = {}, [], []
        for w in words:
            if w in young:
                continue
            if w in old:
                young[w] = old[w]
                continue
            core = w.rstrip(_TAIL)
            # Which letters a library knows may differ beyond Latin, and then marks could join an unknown one.
            if not core.isalpha() or len(core) > 200 or (len(core) < len(w) and core[-1] > _LATIN):
                other.append(w)
                continue
            if len(core) < len(w):  # its marks are a pre-token of their own
                tails[w] = core
                if core in young or core in old:
                    young.setdefault(core, old.get(core))
                    continue
            letters.append(core)
        self._letters(list(dict.fromkeys(letters)), young)
        marks = {w[len(core) :] for w, core in tails.items()}.difference(young)
        other += marks.difference(other)
        young.update(zip(other, self._each(other), strict=True))
        for w, core in tails.items():
            young[w] = young[core] + young[w[len(core) :]]
        return [young[w] for w in words]

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each text followed by ``end_id``; and where texts begin."""
        # A-Z may be lowered early, but not in texts that could spell a special token.
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = words.flatten().dictionary_encode()
        ids = [*self._ids(coded.dictionary.to_pylist()), np.array([end_id], "<u4").tobytes()]
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        codes = np.insert(coded.indices.to_numpy(), bounds[1:], len(ids) - 1)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        length = size[codes]
        stop = np.cumsum(length)
        flat = pool[np.repeat(start[codes] - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)]
        return flat, np.r_[0, stop[bounds[1:] + np.arange(len(texts))]] if len(texts) else np.zeros(1, np.int64)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        tok = WordTokenizer.get(path)
        for b in batches:
            docs = b.column(0).to_pylist()
            for first, count in slices(b.column(1), SLICE):
                ids, bounds = tok.encode(b.column(1).slice(first, count), end_id)
                out: list[list[int]] = [[] for _ in _PIECE_NAMES]
                for doc, begin, stop in zip(docs[first : first + count], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for at in range(begin, stop, capacity):
                        piece = ids[at : min(at + capacity, stop)]
                        for o, v in zip(out, (doc, at - begin, len(piece), zlib.crc32(piece), stop - begin), strict=True):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=_PIECE_NAMES)

    return run


class OpenWindows:
    """Open windows by remaining room; a segment tree finds the tightest that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        i = room + self.leaves
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Room and number of the tightest window with at least this room, which it removes."""
        tree, i = self.tree, least + self.leaves
        if not tree[i]:
            while i > 1 and not (i & 1 == 0 and tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        window = self.at[room].pop()
        if not self.at[room]:
            while i:
                tree[i] = 0
                if tree[i ^ 1]:
                    break
                i >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces of equal length go in the order given."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, used = OpenWindows(capacity), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = open_.take(n)
        if found is None:
            room, at, used = capacity, used, used + 1
        else:
            room, at = found
        window[k], offset[k] = at, capacity - room
        if room > n:
            open_.add(room - n, at)
    return window, offset


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = best_fit_decreasing(t["length"].to_numpy(), capacity)
        group = t["grp"].to_numpy()
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array((group << 32) | window)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    raw = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
    pieces = materialize(raw.mapInArrow(_pieces(tokenizer_path, end_id, capacity), _PIECES), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack(capacity), f"{_PIECES}, sequence_id long, offset long")
