"""Packing of documents into sequences of a fixed number of tokens.

Documents are tokenised where they are read and cut into full sequences and one rest.  Documents are dealt at random (by a
hash) into groups of about `group_docs`; within a group rests are placed by first-fit decreasing: longest first, each into
the first sequence with room, which a tournament tree over the sequences' free room finds in logarithmic time.  Groups are
independent, so packing scales with the data, and each group leaves a few half-filled sequences at most.

A null text counts as empty, and like an empty one has the end token alone.  Repeated rows are packed each.  A text longer than
a sequence gives several pieces.  Ties in length are broken by the order in which a group's pieces come.  An empty table gives an empty table.  Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import slices, text_or_empty

# How a tokenizer must treat text for its words, between white space, to have tokens that depend on nothing else.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

#: A word whose tokens depend on nothing else, in the alphabet of which each letter is its own normal form, and a mark after it.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]?)")
MOST_KNOWN = 800_000


@functools.lru_cache(1)
def _letters() -> dict[int, str]:
    """How byte-level vocabularies write PLAIN's letters beyond ASCII: a letter for each byte of UTF-8.

    A byte's letter is itself where that is printable, else the next free one from 256.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    of_byte = [chr(b) if b in shown else chr(next(rest)) for b in range(256)]
    return {c: "".join(of_byte[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class WordIds:
    """Token ids of texts, working out each white-space separated word once; whole texts where the tokenizer is of another make."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        self.by_word = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and made["model"]["type"] == "BPE"
        self.special = {t["content"][:2].encode() for t in made["added_tokens"]}
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.start, self.size = array("I"), array("q"), array("q")

    def _add(self, word: bytes) -> int:
        text = word.decode()
        plain = PLAIN.fullmatch(text.lower())
        if not plain:
            ids = self.library.encode(text, add_special_tokens=False).ids
        elif plain[2]:  # the word and its mark have tokens of their own
            ids = [x for part in plain.groups() for x in self._known(part.encode())]
        else:
            ids = [t.id for t in self.library.model.tokenize(plain[1].translate(_letters()))]
        self.number[word] = at = len(self.start)
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return at

    def _known(self, word: bytes) -> array:
        at = self.number.get(word)
        if at is None:
            at = self._add(word)
        return self.flat[self.start[at] : self.start[at] + self.size[at]]

    def encode(self, text: bytes, end: int) -> np.ndarray:
        if not self.by_word or any(t in text for t in self.special):  # may hold a special token, which is looked for before all else
            return np.array([*self.library.encode(text.decode(), add_special_tokens=False).ids, end], np.uint32)
        own = text.lower().split()
        number = self.number
        for w in set(own).difference(number):
            if w not in number:  # a word's mark may have brought it in meanwhile
                self._add(w)
        at = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
        size = np.frombuffer(self.size, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        out = np.empty(int(size.sum()) + 1, np.uint32)
        if len(at):
            stops = np.cumsum(size)
            first = np.frombuffer(self.start, np.int64)[at]
            out[:-1] = np.frombuffer(self.flat, np.uint32)[np.repeat(first - (stops - size), size) + np.arange(stops[-1])]
        out[-1] = end
        if len(number) > MOST_KNOWN:
            self.clear()
        return out


@functools.lru_cache(1)
def _words(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end: int = 2, seed: int = 7, with_ids: bool = False) -> DataFrame:
    """(deal, id, start, length, ids_crc32, doc_tokens) for each piece; with_ids: and ids, little-endian in a binary."""
    id_type = docs.schema[id_col].dataType
    names = ["deal", "id", "start", "length", "ids_crc32", "doc_tokens"]
    longs = T.LongType()
    schema = T.StructType([T.StructField(n, id_type if n == "id" else longs) for n in names] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for part in slices(batches, "text"):
            took, numbers, raw = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = words.encode(text, end)
                for at in range(0, len(ids), length):
                    own = ids[at : at + length].astype("<u4").tobytes()
                    took.append(i)
                    numbers.append((at, len(own) // 4, zlib.crc32(own), len(ids)))
                    if with_ids:
                        raw.append(own)
            take = pa.array(took, pa.int64())
            cols = [pa.array(c) for c in np.array(numbers, np.int64).T]
            yield pa.RecordBatch.from_arrays([part.column("deal").take(take), part.column("id").take(take), *cols, *([pa.array(raw, pa.binary())] if with_ids else [])], [f.name for f in schema.fields])

    deal = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.monotonically_increasing_id())
    base = docs.select(deal.alias("deal"), F.col(id_col).alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    return base.mapInArrow(run, schema)


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each size, longest first, each in the first bin with room for it.

    Bins are leaves of a tree in which a node holds the most room below it; a piece goes down to the left where that has room.
    """
    leaves = 1 << max(0, int(len(sizes) - 1)).bit_length()
    tree = [room] * (2 * leaves)
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        need, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i], places[i] = at - leaves, room - tree[at]
        tree[at] -= need
        at //= 2
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
    return bins, places


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end: int = 2, group_docs: int = 4096, with_ids: bool = False) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each document."""
    groups = max(1, -(-docs.count() // group_docs))
    pieces = token_pieces(docs, tokenizer, id_col, text_col, length, end, with_ids=with_ids).withColumn("group", F.pmod("deal", F.lit(groups))).drop("deal")

    def place(own: pd.DataFrame) -> pd.DataFrame:
        size = own["length"].to_numpy()
        own = own.iloc[np.argsort(-size, kind="stable")]
        bins, places = first_fit_decreasing(own["length"].to_numpy(), length)
        return own.assign(sequence_id=(own["group"].to_numpy() << 32) + bins, offset=places).drop(columns="group")

    fields = [f for f in pieces.schema.fields if f.name != "group"]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.groupBy("group").applyInPandas(place, schema).withColumnRenamed("id", id_col)
