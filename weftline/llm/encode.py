"""Problem 7: encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts are cut into pieces by the tokenizer's public pattern; the distinct pieces of an Arrow batch are encoded together
in numpy. Pieces are bucketed by byte length into padded id matrices. In each round every row looks up the rank of all
its neighbouring pairs in one open-addressing hash table, merges its leftmost pair of minimum rank and is compacted by
one place; finished rows leave the matrix. Long pieces merge all non-overlapping occurrences of their minimum pair,
leftmost first, in one round: a merge never makes a pair of lower rank than its own, so the result is the same and the
number of rounds stays far below the length.

Defined results: null and empty texts give an empty list; a text of blanks is encoded as any other; lone surrogates
can't occur in Spark strings; repeated rows are encoded each; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the default vocabulary file and where the vocabulary files lie if no path is given.
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
TOKENIZER_DIR = "/opt/tokenizers"
#: Pieces longer than this many bytes merge all occurrences of their minimum pair in a round.
LONG_PIECE = 48
#: Most pieces a worker keeps encoded from one batch to the next.
KEPT_PIECES = 200_000
#: Largest number of cells of one padded matrix.
MATRIX_CELLS = 4_000_000

_NONE = np.int64(1 << 40)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """The path of a public vocabulary file: beside the installed package if there is one, else in the usual folder."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes in ascending order for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))})
    return table


class PairTable:
    """Open-addressing hash table from a pair of ids to its merge rank and merged id."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, _NONE, np.int64)
        self.merged = np.zeros(1 << bits, np.int32)
        slots = self._home(keys)
        pending, self.probes = np.arange(len(keys)), 1
        while len(pending):
            at = slots[pending]
            free = self.keys[at] == -1
            first = np.zeros(len(pending), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = pending[free & first]
            self.keys[slots[put]], self.rank[slots[put]], self.merged[slots[put]] = keys[put], ranks[put], merged[put]
            pending = pending[~(free & first)]
            slots[pending] = (slots[pending] + 1) & self.mask
            self.probes += bool(len(pending))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        at = self._home(keys)
        out = np.full(keys.shape, -1, np.int64)
        todo = np.arange(keys.size)
        flat, slots, res = keys.ravel(), at.ravel(), out.ravel()
        for _ in range(self.probes + 1):
            held = self.keys[slots[todo]]
            hit = held == flat[todo]
            res[todo[hit]] = slots[todo[hit]]
            todo = todo[~hit & (held != -1)]
            if not len(todo):
                break
            slots[todo] = (slots[todo] + 1) & self.mask
        return res.reshape(keys.shape)


class ByteBpe:
    """A byte-level BPE vocabulary with batch encoding of distinct pieces."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        symbols = _byte_symbols()
        self.byte_id = np.zeros(256, np.int32)
        for s, b in symbols.items():
            self.byte_id[b] = vocab[s]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        self.table = PairTable(left * self.width + right, np.arange(len(merges), dtype=np.int64), np.array([vocab[a + b] for a, b in merges], np.int32))
        self.pattern = regex.compile(_pattern())
        self.kept: dict[str, np.ndarray] = {}

    def _pair_slots(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = ids[:, :-1].astype(np.int64) * self.width + ids[:, 1:]
        inside = np.arange(ids.shape[1] - 1) < (size - 1)[:, None]
        slots = np.full(keys.shape, -1, np.int64)
        slots[inside] = self.table.find(keys[inside])
        return slots, np.where(slots >= 0, self.table.rank[slots], _NONE)

    def _merge_short(self, ids: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """All rows have at least two ids; each round merges the leftmost minimum-rank pair of every row."""
        out: list[np.ndarray] = [None] * len(ids)  # type: ignore[list-item]
        rows = np.arange(len(ids))
        slots, ranks = self._pair_slots(ids, size)
        while len(rows):
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            done = ranks[line, at] == _NONE
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k, : size[k]].copy()
            go = ~done
            rows, ids, size, slots, ranks, at = rows[go], ids[go], size[go], slots[go], ranks[go], at[go]
            if not len(rows):
                break
            line, width = np.arange(len(rows)), ids.shape[1]
            ids[line, at] = self.table.merged[slots[line, at]]
            cols = np.arange(width)
            src = np.minimum(cols + (cols > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, src, 1)[:, : width - 1]
            psrc = np.minimum(cols[:-1] + (cols[:-1] > at[:, None]), width - 2)
            slots = np.take_along_axis(slots, psrc, 1)[:, : max(1, width - 2)]
            ranks = np.take_along_axis(ranks, psrc, 1)[:, : max(1, width - 2)]
            size = size - 1
            if ids.shape[1] == 1:
                for k in range(len(rows)):
                    out[rows[k]] = ids[k, :1].copy()
                break
            # only the pairs on both sides of the merged place have changed
            for shift in (-1, 0):
                pos = at + shift
                ok = (pos >= 0) & (pos + 1 < size)
                r, p = line[ok], pos[ok]
                s = self.table.find(ids[r, p].astype(np.int64) * self.width + ids[r, p + 1])
                slots[r, p], ranks[r, p] = s, np.where(s >= 0, self.table.rank[s], _NONE)
                r, p = line[(pos >= 0) & (pos + 1 >= size)], pos[(pos >= 0) & (pos + 1 >= size)]
                keep = p < ranks.shape[1]
                ranks[r[keep], p[keep]] = _NONE
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece; each round merges all occurrences of its minimum pair, leftmost first."""
        while len(ids) > 1:
            slots = self.table.find(ids[:-1].astype(np.int64) * self.width + ids[1:])
            ranks = np.where(slots >= 0, self.table.rank[slots], _NONE)
            low = ranks.min()
            if low == _NONE:
                break
            hit = ranks == low
            place = np.flatnonzero(hit)
            run_start = np.r_[True, np.diff(place) > 1]
            first = np.maximum.accumulate(np.where(run_start, place, 0))
            place = place[(place - first) % 2 == 0] if ids[place[0]] == ids[place[0] + 1] else place
            ids = ids.copy()
            ids[place] = self.table.merged[slots[place]]
            ids = np.delete(ids, place + 1)
        return ids

    def encode_pieces(self, pieces: list[str]) -> None:
        """Encode pieces that aren't kept yet, bucket by bucket of byte length."""
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.kept]
        raw = [p.encode("utf-8") for p in new]
        buckets: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            n = len(b)
            if n == 1:
                self.kept[new[k]] = self.byte_id[np.frombuffer(b, np.uint8)]
            elif n > LONG_PIECE:
                self.kept[new[k]] = self._merge_long(self.byte_id[np.frombuffer(b, np.uint8)])
            else:
                buckets.setdefault((n + 3) // 4 * 4, []).append(k)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                size = np.array([len(raw[k]) for k in part], np.int64)
                flat = np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in part), np.uint8).reshape(len(part), width)
                for k, ids in zip(part, self._merge_short(self.byte_id[flat], size), strict=True):
                    self.kept[new[k]] = ids

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of a batch of texts."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        self.encode_pieces([p for pieces in cut for p in pieces])
        kept = self.kept
        lists = [[kept[p] for p in pieces] for pieces in cut]
        sizes = [sum(map(len, ids)) for ids in lists]
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        flat = [x for ids in lists for x in ids]
        return offsets, np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)


def _pattern() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.PATTERN
    except (ImportError, AttributeError):
        return r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_LOADED: dict[str, ByteBpe] = {}


def load_tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _tokens(df: DataFrame, text_col: str, out_col: str, path: str | None, counts: bool) -> DataFrame:
    path = path or tokenizer_path()
    kind = T.LongType() if counts else T.ArrayType(T.IntegerType(), False)
    kept = [f for f in df.schema.fields if f.name != out_col]
    schema = T.StructType([*kept, T.StructField(out_col, kind, False)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_tokenizer(path)
        for batch in batches:
            offsets, flat = bpe.encode_batch(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            column = pa.array(np.diff(offsets).astype(np.int64)) if counts else pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), column], names=[*names, out_col])

    return df.mapInArrow(run, schema)


def encode_corpus(df: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text_col`` in ``out_col`` (a list of integers, empty for null and empty texts).

    A column that is already called ``out_col`` is replaced. No shuffle: each input split is encoded where it is read.
    """
    return _tokens(df, text_col, out_col, path, counts=False)


def count_tokens(df: DataFrame, text_col: str = "text", out_col: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` without ``text_col`` and with its number of tokens (0 for null and empty texts)."""
    return _tokens(df, text_col, out_col, path, counts=True).drop(text_col)


def read_splits(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores.

    Compressed text files can be few while encoding is CPU-bound; a read that already has enough splits isn't shuffled.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(2 * want)


def p7_ids(spark, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_corpus(read_splits(docs)).select("doc_id", F.col("ids"))
