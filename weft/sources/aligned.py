"""Line-aligned files of two sides, read in step by a data source of their own.

Line n of {root}/{src}-{tgt}/{split}.{src} and of {split}.{tgt} are one row.  Files are cut into blocks of bytes.  A first pass
counts the line feeds of each block; sums of these counts tell at which block of either file a line is found, and how many line feeds
lie between that block's start and the line.  So each task reads the lines that begin in its block of the source, and the same
lines of the target, and nothing is joined or shuffled.  The driver holds a few numbers for each block, as it does for the splits
of any table.

Only a line feed ends a line; bytes that are no UTF-8 are left out.  Sides of different lengths are an error.

The stream follows files that grow: a batch takes the lines that both sides have whole (up to the line feed), and what only one side
has waits for the other.
"""

from __future__ import annotations

import io
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from weft.session import ship

SCHEMA = "pair string, split string, line_no long, src_lang string, tgt_lang string, src_text string, tgt_text string"
BLOCK = 128 << 20
#: Lines of a batch of rows, and bytes read at a time.
ROWS, CHUNK = 8192, 4 << 20


def _at(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


@dataclass
class Pair:
    """Files of two sides and their sizes."""

    src_lang: str
    tgt_lang: str
    src: str
    tgt: str
    src_size: int
    tgt_size: int


def pairs_of(root: str, split: str) -> list[Pair]:
    """Pairs under root that have files of both of their languages, in order; a language with itself is no pair."""
    system, top = _at(root)
    out = []
    for folder in system.get_file_info(pa.fs.FileSelector(top, allow_not_found=True)):
        if folder.type != pa.fs.FileType.Directory or not (m := re.fullmatch(r"(.+)-([^-]+)", folder.base_name)) or m[1] == m[2]:
            continue
        sides = system.get_file_info([f"{folder.path}/{split}.{lang}" for lang in m.groups()])
        if all(x.is_file for x in sides):
            out.append(Pair(m[1], m[2], *(f"{root}/{folder.base_name}/{x.base_name}" for x in sides), *(x.size for x in sides)))
    return sorted(out, key=lambda p: (p.src_lang, p.tgt_lang))


# Counting


@dataclass
class Block(InputPartition):
    path: str
    number: int
    start: int
    stop: int


class _CountReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.block = json.loads(options["files"]), int(options["block"])

    def partitions(self) -> list[Block]:
        return [Block(path, k, at, min(at + self.block, size)) for path, size in self.files for k, at in enumerate(range(0, size, self.block))]

    def read(self, partition: Block) -> Iterator[tuple]:
        system, path = _at(partition.path)
        lines, last = 0, b""
        with system.open_input_file(path) as f:
            for at in range(partition.start, partition.stop, CHUNK):
                data = f.read_at(min(CHUNK, partition.stop - at), at)
                lines, last = lines + data.count(b"\n"), data[-1:]
        yield partition.path, partition.number, lines, last == b"\n"


class LineCounts(DataSource):
    """(path, block, lines, ended): the line feeds of each block of files, and whether its last byte is one."""

    @classmethod
    def name(cls) -> str:
        return "line_counts"

    def schema(self) -> str:
        return "path string, block int, lines long, ended boolean"

    def reader(self, schema) -> _CountReader:
        return _CountReader(self.options)


class Places:
    """Where lines of a file are: the line feeds before each of its blocks, and how many lines it has."""

    def __init__(self, counts: list[tuple[int, int, bool]], block: int):
        counts = sorted(counts)
        self.before, self.block = [0, *accumulate(n for _, n, _ in counts)], block
        self.lines = self.before[-1] + (0 if not counts or counts[-1][2] else 1)

    def find(self, line: int) -> tuple[int, int]:
        """Where to start reading, and how many line feeds to pass before the line begins."""
        if line == 0:
            return 0, 0
        k = bisect_right(self.before, line - 1, hi=len(self.before) - 1) - 1  # the block of the line feed that ends the line before
        return k * self.block, line - self.before[k]

    def begun(self, k: int) -> tuple[int, int]:
        """The lines that begin behind the line feeds of block k; block 0 also has the first one."""
        return (self.before[k] + 1 if k else 0), min(self.before[k + 1] + 1, self.lines)


# Reading in step


@dataclass
class Step(InputPartition):
    """Some lines of both sides: where reading starts, line feeds to pass, the first line's number and how many there are."""

    src_lang: str
    tgt_lang: str
    src: str
    tgt: str
    src_at: int
    src_pass: int
    tgt_at: int
    tgt_pass: int
    first: int
    n: int


def _lines(path: str, at: int, passed: int, n: int) -> Iterator[str]:
    system, own = _at(path)
    with system.open_input_file(own) as f:
        f.seek(at)
        with io.BufferedReader(f, CHUNK) as lines:
            for line in islice(lines, passed, passed + n):
                yield line.removesuffix(b"\n").decode("utf-8", "ignore")


def _rows(step: Step, split: str) -> Iterator[pa.RecordBatch]:
    both = zip(_lines(step.src, step.src_at, step.src_pass, step.n), _lines(step.tgt, step.tgt_at, step.tgt_pass, step.n), strict=True)
    at = step.first
    while part := list(islice(both, ROWS)):
        n = len(part)
        same = lambda x: pa.array([x] * n, pa.string())  # noqa: B023, E731
        columns = [same(f"{step.src_lang}-{step.tgt_lang}"), same(split), pa.array(range(at, at + n), pa.int64()), same(step.src_lang), same(step.tgt_lang), *(pa.array(x, pa.string()) for x in zip(*part, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["pair", "split", "line_no", "src_lang", "tgt_lang", "src_text", "tgt_text"])
        at += n


class _AlignedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.split, self.steps = options["split"], json.loads(options["steps"])

    def partitions(self) -> list[Step]:
        return [Step(**x) for x in self.steps]

    def read(self, partition: Step) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition, self.split)


class _AlignedStream(DataSourceStreamReader):
    """Offsets: for each pair the bytes of either side and the lines that have been taken."""

    def __init__(self, options: dict):
        self.root, self.split, self.most, self.progress = options["path"], options.get("split", "train"), int(options.get("most", 64 << 20)), options.get("progress")
        self.taken, self.begun = {}, False
        if self.progress:
            system, path = _at(self.progress)
            if system.get_file_info(path).is_file:
                with system.open_input_file(path) as f:
                    self.taken = json.loads(f.read())

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """From what was taken last, as far as both sides have whole lines, `most` bytes of a side at a time.

        A reader that was just started does not know the batch that Spark goes on from, which may be behind the progress it
        kept.  So its first offset is all there is: it is never before that batch."""
        known, most = self.taken, self.most if self.begun else None
        out, self.begun = dict(known), True
        for p in pairs_of(self.root, self.split):
            name = f"{p.src_lang}-{p.tgt_lang}"
            old = known.get(name, {"src": 0, "tgt": 0, "line": 0})
            ends = [_feeds(x, old[side], most) for side, x in (("src", p.src), ("tgt", p.tgt))]
            n = min(map(len, ends))
            if n:
                out[name] = {"src": ends[0][n - 1], "tgt": ends[1][n - 1], "line": old["line"] + n}
        self.taken = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Step]:
        out = []
        for name, new in sorted(end.items()):
            old = start.get(name, {"src": 0, "tgt": 0, "line": 0})
            if new["line"] > old["line"]:
                src, tgt = name.rsplit("-", 1)
                paths = [f"{self.root}/{name}/{self.split}.{x}" for x in (src, tgt)]
                out.append(Step(src, tgt, *paths, old["src"], 0, old["tgt"], 0, old["line"], new["line"] - old["line"]))
        return out

    def read(self, partition: Step) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition, self.split)

    def commit(self, end: dict) -> None:
        if self.progress:
            system, path = _at(self.progress)
            with system.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(end).encode())
            system.move(f"{path}.new", path)


def _feeds(path: str, at: int, most: int | None) -> list[int]:
    """Where the lines that begin at byte `at` and later end, within `most` bytes; a line longer than that is read whole."""
    system, own = _at(path)
    ends: list[int] = []
    with system.open_input_file(own) as f:
        size, place = f.size(), at
        while place < size and (most is None or place - at < most or not ends):
            data = f.read_at(min(CHUNK, size - place, *([max(1, most - (place - at))] if most and place - at < most else [])), place)
            ends += [place + m.end() for m in re.finditer(b"\n", data)]
            place += len(data)
    return ends


class Aligned(DataSource):
    """Rows of line-aligned files.  As a stream: options path, split, most (bytes a side and batch, from the second batch on) and
    progress (a file that the stream keeps, so that it need not count its files from the start when it is started again)."""

    @classmethod
    def name(cls) -> str:
        return "aligned_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _AlignedReader:
        return _AlignedReader(self.options)

    def streamReader(self, schema) -> _AlignedStream:  # noqa: N802
        return _AlignedStream(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make both data sources known to the session."""
    spark.dataSource.register(LineCounts)
    spark.dataSource.register(Aligned)
    return ship(spark)


def read_aligned(spark: SparkSession, root: str, split: str = "train", domain: str | None = None, block: int = BLOCK) -> DataFrame:
    """Bitext rows as read_bitext() gives them, each side read once and in step; sides of different lengths are an error."""
    register(spark)
    found = pairs_of(root, split)
    files = [x for p in found for x in ((p.src, p.src_size), (p.tgt, p.tgt_size))]
    counted: dict[str, list[tuple[int, int, bool]]] = {path: [] for path, _ in files}
    if any(size for _, size in files):  # a source without partitions can't be read
        for r in spark.read.format("line_counts").option("files", json.dumps(files)).option("block", block).load().collect():  # a row for each block
            counted[r["path"]].append((r["block"], r["lines"], r["ended"]))
    steps = []
    for p in found:
        src, tgt = (Places(counted[x], block) for x in (p.src, p.tgt))
        if src.lines != tgt.lines:
            raise ValueError(f"source and target differ in length: {p.src_lang}-{p.tgt_lang} {src.lines} {tgt.lines}")
        for k in range(len(src.before) - 1):
            first, stop = src.begun(k)
            if stop > first:
                (a, b), (c, d) = src.find(first), tgt.find(first)
                steps.append(Step(p.src_lang, p.tgt_lang, p.src, p.tgt, a, b, c, d, first, stop - first).__dict__)
    rows = spark.read.format("aligned_lines").option("split", split).option("steps", json.dumps(steps)).load() if steps else spark.createDataFrame([], SCHEMA)
    return rows.select("pair", "split", F.lit(domain).cast("string").alias("domain"), "line_no", "src_lang", "tgt_lang", "src_text", "tgt_text")


def follow_aligned(spark: SparkSession, root: str, split: str = "train", most: int = 64 << 20, progress: str | None = None) -> DataFrame:
    """A stream of the rows of files that grow; progress: a file of the stream's own, beside its checkpoint."""
    read = register(spark).readStream.format("aligned_lines").option("path", root).option("split", split).option("most", most)
    return (read.option("progress", progress) if progress else read).load()
