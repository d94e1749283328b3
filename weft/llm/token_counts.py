"""Token counts by pre-token, without materialising ids.

The tokenizer joins no pieces across the start of a run of blanks or across a line feed (no piece of its vocabulary holds a
blank after another character, or a line feed; _tokenizer() checks this), so a text's count is the sum over its pre-tokens:
a run of blanks with what follows, or a line feed.

Each task gathers its documents' pre-token frequencies as posting lists: for each pre-token the documents and how often each
has it.  Lists are dealt out by buckets of pre-tokens (a row holds one task's lists of a bucket, packed), so the lists of a
pre-token meet in one task, which counts its pieces once, joins the count to the lists and sums by document.  A long list goes
to a bucket of its task's own, so a frequent pre-token is counted in several tasks (once in each) instead of filling one.
The sums go back, packed, to the block of documents that they belong to and are added up there.

A null text counts as empty and has no tokens.  Very long texts are counted whole.  Repeated rows each give a row; there is
nothing to tie.  An empty table gives an empty table.  Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.llm.common import slices, text_or_empty

BLANK = "▁"
PRETOKEN = re.compile(" +[^ \n]*|[^ \n]+|\n")
#: Documents whose sums are added up together.
BLOCK = 2048
#: Postings and distinct pre-tokens that a task holds before it gives its lists; documents in a list that counts as long.
MOST_POSTINGS, MOST_UNITS, LONG_LIST = 4_000_000, 600_000, 1024


@functools.lru_cache(1)
def _tokenizer(model: str):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(own.get_piece_size()):
        piece = own.id_to_piece(i)
        if BLANK in piece.lstrip(BLANK) or "\n" in piece:
            raise ValueError(f"the piece {piece!r} crosses pre-tokens")
    return own


def pretokens(text: str) -> list[str]:
    """Pre-tokens, blanks as spaces, with the blank that the tokenizer puts before a text."""
    return PRETOKEN.findall(" " + text.replace(BLANK, " ")) if text else []


def piece_counts(model: str, units: list[str]) -> np.ndarray:
    """Number of pieces of each pre-token, by the library."""
    own = _tokenizer(model)
    asked = [u[1:] if u[0] == " " else "\n" + u for u in units]  # the library puts a blank before each text
    lengths = np.fromiter(map(len, own.encode(asked, num_threads=1)), np.int64, len(units))
    extra = np.fromiter((0 if u[0] == " " else 2 for u in units), np.int64, len(units))
    return np.where([u == " " for u in units], 1, lengths - extra)


def _packed(x: np.ndarray, least: str) -> bytes:
    """Numbers as bytes: of the small type where they fit, else of four bytes each; the length tells which."""
    small = np.dtype(least)
    return x.astype(small if len(x) == 0 or x.max() <= np.iinfo(small).max else "<u4").tobytes()


def _unpacked(x: bytes, n: int, least: str) -> np.ndarray:
    return np.frombuffer(x, least if len(x) == n * np.dtype(least).itemsize else "<u4").astype(np.int64)


def _postings(buckets: int, schema: pa.Schema):
    def lists(units: list[str], codes: list, rows: list, freqs: list, base: int) -> Iterator[pa.RecordBatch]:
        code, row, freq = (np.concatenate(x) for x in (codes, rows, freqs))
        order = np.argsort(code, kind="stable")
        code, row, freq = code[order], row[order], freq[order]
        size = np.bincount(code, minlength=len(units))
        bucket = np.fromiter((zlib.crc32(u.encode()) for u in units), np.int64, len(units))
        bucket = np.where(size > LONG_LIST, bucket + zlib.crc32(b"%d" % base), bucket) % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        starts = np.cumsum(size) - size
        # postings in the order of buckets: each unit's run of postings is moved as a whole
        moved = size[by_bucket]
        at = np.repeat(starts[by_bucket] - (np.cumsum(moved) - moved), moved) + np.arange(len(row))
        row, freq = row[at], freq[at]
        cuts = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
        ends = np.r_[cuts[1:], len(units)]
        posting = np.r_[0, np.cumsum(moved)]
        out = {"bucket": [], "units": [], "sizes": [], "rows": [], "freqs": []}
        for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
            own = slice(posting[a], posting[b])
            out["bucket"].append(int(bucket[by_bucket[a]]))
            out["units"].append("\n".join(["" if units[i] == "\n" else units[i] for i in by_bucket[a:b].tolist()]))
            out["sizes"].append(_packed(moved[a:b], "u1"))
            out["rows"].append(_packed(row[own], "<u2"))
            out["freqs"].append(_packed(freq[own], "u1"))
        yield _batch(schema, len(cuts), out | {"base": [base] * len(cuts)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = None
        numbers: defaultdict[str, int] = defaultdict(count().__next__)
        codes, rows, freqs, held = [], [], [], 0
        for part in slices(batches, "text"):
            row = part.column("row").to_pylist()
            base = row[0] if base is None else base
            at = [r - base for r in row]
            lengths = pa.compute.binary_length(part.column("text")).to_pylist()
            yield _batch(schema, 1, {"bucket": [zlib.crc32(b"%d" % row[0]) % buckets], "base": [base], "at": [at], "ids": [part.column("id").to_pylist()], "bytes": [lengths]})
            for r, text in zip(at, part.column("text").to_pylist(), strict=True):
                if units := pretokens(text):
                    code, freq = np.unique(np.fromiter(map(numbers.__getitem__, units), np.int32, len(units)), return_counts=True)
                    codes.append(code)
                    rows.append(np.full(len(code), r, np.int32))
                    freqs.append(freq)
                    held += len(code)
            if held >= MOST_POSTINGS or len(numbers) >= MOST_UNITS:
                yield from lists(list(numbers), codes, rows, freqs, base)
                base, held, numbers = None, 0, defaultdict(count().__next__)
                codes, rows, freqs = [], [], []
        if held:
            yield from lists(list(numbers), codes, rows, freqs, base)

    return run


def _batch(schema: pa.Schema, n: int, values: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in schema], schema=schema)


def _sums(model: str, schema: pa.Schema):
    """Sums by document of each row's lists; rows that tell of documents pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for part in slices(batches, "rows"):
            out = {f.name: [] for f in schema}
            for x in part.to_pylist():
                if x["rows"] is None:
                    block = np.array(x["at"]) // BLOCK
                    for k in np.unique(block).tolist():
                        own = np.flatnonzero(block == k).tolist()
                        out["base"].append(x["base"] + k * BLOCK)
                        out["at"].append([x["at"][i] - k * BLOCK for i in own])
                        for name in ("ids", "bytes"):
                            out[name].append([x[name][i] for i in own])
                        out["rows"].append(None)
                        out["sums"].append(None)
                    continue
                units = [u or "\n" for u in x["units"].split("\n")]
                new = [u for u in units if u not in known]
                if len(known) + len(new) > MOST_UNITS:
                    known, new = {}, units
                if new:
                    known.update(zip(new, piece_counts(model, new).tolist(), strict=True))
                pieces = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
                sizes = _unpacked(x["sizes"], len(units), "u1")
                n = int(sizes.sum())
                tokens = np.repeat(pieces, sizes) * _unpacked(x["freqs"], n, "u1")
                rows, where = np.unique(_unpacked(x["rows"], n, "<u2"), return_inverse=True)
                total = np.bincount(where, tokens).astype("<u4")
                cuts = np.flatnonzero(np.diff(rows // BLOCK, prepend=-1))  # each block of documents gets its own sums
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True):
                    out["base"].append(x["base"] + int(rows[a]) // BLOCK * BLOCK)
                    out["rows"].append(_packed(rows[a:b] % BLOCK, "<u2"))
                    out["sums"].append(total[a:b].tobytes())
                    for name in ("at", "ids", "bytes"):
                        out[name].append(None)
            yield _batch(schema, len(out["base"]), out)

    return run


def _totals(schema: pa.Schema):
    """(id, n_bytes, n_tokens) of each document; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sums, docs = None, np.zeros(0, np.int64), []

        def given() -> Iterator[pa.RecordBatch]:
            for at, ids, sizes in docs:
                tokens = [int(sums[i]) if i < len(sums) else 0 for i in at]
                yield _batch(schema, len(at), {"id": ids, "n_bytes": sizes, "n_tokens": tokens})

        for part in batches:
            for x in part.to_pylist():
                if x["base"] != base:
                    yield from given()
                    base, sums, docs = x["base"], np.zeros(0, np.int64), []
                if x["rows"] is None:
                    docs.append((x["at"], x["ids"], x["bytes"]))
                    continue
                own = np.frombuffer(x["sums"], "<u4")
                rows = _unpacked(x["rows"], len(own), "<u2")
                if int(rows[-1]) >= len(sums):
                    sums = np.r_[sums, np.zeros(int(rows[-1]) + 1 - len(sums), np.int64)]
                sums[rows] += own
        yield from given()

    return run


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes long, n_tokens long) for every row, as the library counts the whole text."""
    fields = {
        "bucket": T.IntegerType(), "base": T.LongType(), "units": T.StringType(), "sizes": T.BinaryType(), "rows": T.BinaryType(), "freqs": T.BinaryType(), "sums": T.BinaryType(),
        "at": T.ArrayType(T.LongType()), "ids": T.ArrayType(docs.schema[id_col].dataType), "bytes": T.ArrayType(T.LongType()),
        "id": docs.schema[id_col].dataType, "n_bytes": T.LongType(), "n_tokens": T.LongType(),
    }
    schema = lambda *names: T.StructType([T.StructField(n, fields[n]) for n in names])
    lists = schema("bucket", "base", "units", "sizes", "rows", "freqs", "at", "ids", "bytes")
    sums = schema("base", "rows", "sums", "at", "ids", "bytes")
    totals = schema("id", "n_bytes", "n_tokens")
    buckets = 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    dealt = base.mapInArrow(_postings(buckets, to_arrow_schema(lists)), lists).repartition("bucket")
    back = dealt.mapInArrow(_sums(model, to_arrow_schema(sums)), sums).repartition("base").sortWithinPartitions("base")
    return back.mapInArrow(_totals(to_arrow_schema(totals)), totals).withColumnRenamed("id", id_col)
