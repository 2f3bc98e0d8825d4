"""Rule-based quality verdicts with cross-document line frequencies.

Base rules look at one text: too few words, or too many words inside repeated
three-word windows.  The cross-document rule hashes normalised lines (A-Z
lowered, digits as 0, white space squeezed), counts for every host the
distinct documents that hold a line (equal texts are one document), removes
lines found in more than ``max_docs``, and rejects documents of which that
leaves too little.

Both the line counts and the verdicts depend on a text and its host only, so
copies are pre-aggregated before anything is exploded.  Null and empty texts
have no words and fail; a null host is a host of its own.  Rows repeated under
one ``doc_id`` are judged alike and each kept or not; a long text is measured
in one piece.  Other columns pass whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._work import fits, materialize

WORD_SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Bytes of a text whose words are told apart at once.
SLICE_BYTES = 1 << 20
#: Frequent lines are broadcast up to this many rows, joined by shuffle beyond.
BROADCAST_ROWS = 200_000
#: Changed texts with their removed lines are broadcast up to this many texts and lines, about 40 MB, joined by shuffle beyond.
BROADCAST_LINES = 1_000_000

_NOT_CHARS = WORD_SPACE + bytes(range(0x80, 0xC0))
_NORMAL = bytes(48 if 48 <= c < 58 else c + 32 if 65 <= c < 91 else c for c in range(256))
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "doc_id long, host string, content string, " + ", ".join(f"{m} long" for m in _MEASURES) + ", lines array<long>, line_words array<long>"


def repeated_window_words(words: np.ndarray) -> int:
    """Words, given by number, that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    pair = np.unique(words[:-2] * (int(words.max()) + 1) + words[1:-1], return_inverse=True)[1]
    _, gram, times = np.unique(pair * (int(words.max()) + 1) + words[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[gram] > 1)
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[starts + k] = True
    return int(np.count_nonzero(inside))


def numbered_words(raw: bytes) -> np.ndarray:
    """Words as numbers, equal words equal ones, read in slices: a text of any length costs eight bytes a word and its distinct words."""
    number: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(raw):
        stop = at + SLICE_BYTES
        while stop < len(raw) and raw[stop] not in WORD_SPACE:  # up to the end of a word
            stop += 1
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in raw[at:stop].split()), np.int64))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def line_key(line: bytes) -> tuple[int, int]:
    """Hash of the normalised line (signed), and its words."""
    words = line.translate(_NORMAL).split()
    h = xxhash.xxh64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h, len(words)


def _measure(batches):
    for b in batches:
        out: list[list] = [[] for _ in range(10)]
        for doc, host, content, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            raw = cell.as_buffer().to_pybytes()
            words = numbered_words(raw)
            seen, dups, lines = set(), 0, {}
            for line in raw.split(b"\n"):
                if not line or line.isspace():
                    continue
                dups += line in seen
                seen.add(line)
                h, n = line_key(line)
                lines[h] = lines.get(h, 0) + n
            row = (doc, host, content, len(words), len(raw.translate(None, _NOT_CHARS)), len(raw) - len(raw.translate(None, SYMBOLS)), dups, repeated_window_words(words), list(lines), list(lines.values()))
            for o, v in zip(out, row, strict=True):
                o.append(v)
        types = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["doc_id", "host", "content", *_MEASURES, "lines", "line_words"])


def _frequent(texts: DataFrame, max_docs: int) -> DataFrame:
    """``(host, line)`` found in more than ``max_docs`` distinct texts of a host."""
    return texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").count().where(F.col("count") > max_docs).select("host", "line")


def _host(name: str):
    """A host's key; null and the empty name are two hosts."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _analyse(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """Measures of every row; removed words and lines of every text and host that has any."""
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), _host(host_col).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    raw = raw.select("doc_id", "host", F.md5("raw").alias("content"), "raw")
    rows = materialize(raw.mapInArrow(_measure, _SCHEMA), "measures")
    texts = rows.groupBy("host", "content").agg(F.first(F.struct("lines", "line_words")).alias("x")).select("host", "content", "x.*")
    hot = materialize(_frequent(texts, max_docs), "frequent")
    hot = F.broadcast(hot) if fits(hot, BROADCAST_ROWS) else hot
    each = texts.select("host", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("host", "content", F.col("x.lines").alias("line"), F.col("x.line_words").alias("w"))
    gone = each.join(hot, ["host", "line"]).groupBy("host", "content").agg(F.sum("w").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    return rows, materialize(gone, "removed")


def _failed(min_words: int):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _depleted(max_removed_percent: int, min_left: int):
    gone = F.coalesce("removed_words", F.lit(0))
    return (gone > 0) & ((100 * gone > max_removed_percent * F.col("n_words")) | (F.col("n_words") - gone < min_left))


def quality_verdicts(docs: DataFrame, max_docs: int = 100, min_words: int = 50, max_removed_percent: int = 50, min_left: int = 25, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id``, the five measures, ``removed_words``, ``base_failed`` and ``kept``, one row per input row."""
    rows, gone = _analyse(docs, id_col, text_col, host_col, max_docs)
    gone = gone.select("host", "content", "removed_words")
    joined = rows.select("doc_id", "host", "content", *_MEASURES).join(gone, ["host", "content"], "left")
    failed = _failed(min_words)
    return joined.select("doc_id", *_MEASURES, F.coalesce("removed_words", F.lit(0)).alias("removed_words"), failed.alias("base_failed"), (~failed & ~_depleted(max_removed_percent, min_left)).alias("kept"))


def _strip_lines(batches):
    for b in batches:
        out = []
        for cell, drop in zip(b["raw"], b["drop"].to_pylist(), strict=True):
            drop = set(drop)
            lines = cell.as_buffer().to_pybytes().split(b"\n")
            out.append(b"\n".join(x for x in lines if not x.split() or line_key(x)[0] not in drop).decode())
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(out, pa.string())], names=["row", "left"])


def keep_good(docs: DataFrame, max_docs: int = 100, min_words: int = 50, max_removed_percent: int = 50, min_left: int = 25) -> DataFrame:
    """Kept rows of ``docs``, all columns, their too frequent lines removed and ``n_chars`` recounted."""
    rows, gone = _analyse(docs, "doc_id", "text", "source", max_docs)
    per_text = rows.groupBy("host", "content").agg(F.first("n_words").alias("n_words"), F.first("n_repeat_words").alias("n_repeat_words"))
    verdict = per_text.join(gone, ["host", "content"], "left").select("host", "content", (~_failed(min_words) & ~_depleted(max_removed_percent, min_left)).alias("kept"), F.col("removed_lines").alias("drop"))
    verdict = materialize(verdict.where("NOT kept OR drop IS NOT NULL"), "changed")
    verdict = F.broadcast(verdict) if fits(verdict, BROADCAST_LINES, "drop") else verdict
    # The row travels as one value, so that no column of it can clash with a column made here.
    keyed = docs.select(F.struct("*").alias("row"), _host("source").alias("host"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    kept = keyed.join(verdict, ["host", "content"], "left").where("kept IS NULL OR kept")
    same = kept.where("drop IS NULL").select("row.*")
    cut = kept.where("drop IS NOT NULL").select("row", F.col("row.text").cast("binary").alias("raw"), "drop")
    cut = cut.mapInArrow(_strip_lines, cut.select("row").schema.add("left", "string"))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return same.union(cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
