"""One large JSON file read as many ranges, and many small files written by one task.

A range of bytes says nothing of where it starts: within a string or not, and how deep. So a first pass summarises each
range under both assumptions: by how much it changes the depth, where it first falls to each lower depth, and where the
wanted array may open. The summaries, one small row a range, are put in order and tell each range its true start; a
second pass then yields the array's elements that begin in each range. Both passes are Python data sources, a task for
ranges of 8 MB together; strings and brackets are found with array operations.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RANGE_BYTES, BEHIND = 8 << 20, 1 << 16
#: Ranges are not put together in fewer tasks than this.
LEAST_TASKS = 64
QUOTE, BACKSLASH = 34, 92
#: What each byte adds to the depth.
STEP = np.zeros(256, np.int8)
STEP[[ord("["), ord("{")]], STEP[[ord("]"), ord("}")]] = 1, -1
#: The first bytes read of a value that goes on beyond its range; twice as many each time after.
FIRST_READ = 1 << 12
SUMMARY = "path string, start long, starts_inside boolean, ends_inside boolean, change long, falls array<long>, arrays array<struct<at:long,depth:long,closes:long>>"


def _opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the JSON files of a folder."""
    from pyarrow import fs

    system, name = _opened(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        found = [x for x in system.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.path.endswith(".json")]
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((prefix + x.path, x.size) for x in found)


def read_bytes(path: str, start: int, size: int) -> bytes:
    system, name = _opened(path)
    with system.open_input_file(name) as file:
        file.seek(start)
        return file.read(max(0, size))


def _escaped_before(path: str, start: int) -> bool:
    """Whether an odd run of backslashes ends just before a place."""
    run, at = 0, start
    while at > 0:
        part = read_bytes(path, max(0, at - 4096), min(4096, at))
        bare = part.rstrip(b"\\")
        run, at = run + len(part) - len(bare), at - len(part)
        if bare:
            break
    return run % 2 == 1


@dataclass
class Lexed:
    """The quotes and brackets of some bytes: a quote that opens or ends a string, and brackets with their steps."""

    quotes: np.ndarray
    brackets: np.ndarray
    steps: np.ndarray

    def outside(self, starts_inside: bool) -> np.ndarray:
        """Which brackets are in no string."""
        return (np.searchsorted(self.quotes, self.brackets) + starts_inside) % 2 == 0


def lexed(data: bytes, escaped: bool) -> Lexed:
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == QUOTE)
    slashes = np.flatnonzero(raw == BACKSLASH)
    if len(slashes) or escaped:
        # a run's backslashes escape one another; the byte behind an odd run is escaped
        fresh = np.ones(len(slashes), bool)
        fresh[1:] = slashes[1:] != slashes[:-1] + 1
        first = slashes[fresh]
        length = np.diff(np.append(np.flatnonzero(fresh), len(slashes)))
        odd = length % 2 == 1
        if escaped and len(first) and first[0] == 0:
            odd[0] = not odd[0]
        hit = (first + length)[odd]
        if escaped and not (len(first) and first[0] == 0):
            hit = np.append(hit, 0)
        behind = np.zeros(len(raw) + 1, bool)
        behind[hit] = True
        quotes = quotes[~behind[quotes]]
    brackets = np.flatnonzero(STEP[raw])
    return Lexed(quotes, brackets, STEP[raw[brackets]].astype(np.int64))


def _keyed(behind: bytes, data: bytes, field: str) -> list[int]:
    """Places in ``data`` of brackets behind the key ``field``, whose own quote may lie in ``behind``."""
    both, out = behind + data, []
    for m in re.finditer(rb'"' + re.escape(field.encode()) + rb'"\s*:\s*\[', both):
        before = both[: m.start()]
        if (len(before) - len(before.rstrip(b"\\"))) % 2 == 0 and m.end() > len(behind):
            out.append(m.end() - 1 - len(behind))
    return out


def summaries(behind: bytes, data: bytes, escaped: bool, field: str | None) -> list[tuple]:
    """(starts_inside, ends_inside, change, falls, arrays) of a range under both assumptions; places count from its start.

    A bracket outside strings that follows a key's text follows a key: the quote before the text, if it isn't escaped,
    opens the string that ends behind the text.
    """
    lex, out = lexed(data, escaped), []
    wanted = [] if field is None else _keyed(behind, data, field)
    for inside in (False, True):
        keep = lex.outside(inside)
        at, steps = lex.brackets[keep], lex.steps[keep]
        depth = np.cumsum(steps)
        low = np.minimum(np.minimum.accumulate(depth), 0) if len(depth) else depth
        new = low < np.concatenate([[0], low[:-1]]) if len(depth) else np.zeros(0, bool)
        arrays = []
        for bracket in wanted if field is not None else at[:1][steps[:1] == 1].tolist():
            i = np.searchsorted(at, bracket)
            if i < len(at) and at[i] == bracket:
                before = int(depth[i]) - 1
                rest = np.flatnonzero(depth[i:] <= before)
                arrays.append((int(bracket), before, int(at[i + rest[0]]) if len(rest) else -1))
        out.append((inside, bool((len(lex.quotes) + inside) % 2), int(steps.sum()), at[new].tolist(), arrays))
    return out


def true_starts(rows: list, field: str | None) -> list[dict]:
    """For each range that holds elements: whether it starts within a string, its depth there, and from where to where
    the array goes (absolute places; up to -1 if it goes on)."""
    level, out, path = 0 if field is None else 1, [], None
    by_range: dict = {}
    for r in rows:
        by_range.setdefault((r["path"], r["start"]), {})[r["starts_inside"]] = r
    for (name, start), both in sorted(by_range.items()):
        if name != path:
            path, inside, depth, state = name, False, 0, "before"
        r = both[inside]
        first, last = (start - 1, -1) if state == "within" else (None, None)
        if state == "before":
            for a in r["arrays"]:
                if depth + a["depth"] == level:
                    state, first, last = "within", start + a["at"], start + a["closes"] if a["closes"] >= 0 else -1
                    break
        elif state == "within" and len(r["falls"]) >= depth - level:
            last = start + r["falls"][depth - level - 1]
        if first is not None:
            out.append({"path": path, "start": start, "inside": inside, "depth": depth, "first": first, "last": last})
        if last is not None and last >= 0:
            state = "after"
        inside, depth = r["ends_inside"], depth + r["change"]
    return out


def elements(path: str, start: int, size: int, inside: bool, depth: int, first: int, last: int, level: int) -> Iterator[str]:
    """The elements (objects or arrays) of depth ``level`` that begin in a range; one is read on until it ends."""
    data = read_bytes(path, start, size)
    lex = lexed(data, _escaped_before(path, start))
    keep = lex.outside(inside)
    at, steps = lex.brackets[keep], lex.steps[keep]
    after = depth + np.cumsum(steps)
    within = (at + start > first) & ((last < 0) | (at + start < last))
    begins = np.flatnonzero(within & (steps == 1) & (after == level + 1))
    ends = np.flatnonzero(within & (steps == -1) & (after == level))
    for i in begins:
        j = np.searchsorted(ends, i)
        if j < len(ends):
            yield data[at[i] : at[ends[j]] + 1].decode()
        else:
            yield _read_on(path, start + int(at[i]))


def _read_on(path: str, start: int) -> str:
    """The bracketed value at a place, however long."""
    data, step = b"", FIRST_READ
    while True:
        more = read_bytes(path, start + len(data), step)
        if not more:
            raise ValueError(f"{path}: the value at byte {start} does not end")
        data += more
        lex = lexed(data, False)
        keep = lex.outside(False)
        done = np.flatnonzero(np.cumsum(lex.steps[keep]) == 0)
        if len(done):
            return data[: lex.brackets[keep][done[0]] + 1].decode()
        step *= 2


@dataclass
class Piece(InputPartition):
    """Consecutive ranges that one task reads: as many as make up ``RANGE_BYTES``, of many."""

    plans: list[dict]

    def __post_init__(self) -> None:
        super().__init__(self.plans)


def pieces(plans: list[dict], size: int) -> list[Piece]:
    each = max(1, min(RANGE_BYTES // size, len(plans) // LEAST_TASKS))
    return [Piece(plans[i : i + each]) for i in range(0, len(plans), each)]


class _Summaries(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size, self.field = options["path"], int(options.get("rangebytes", RANGE_BYTES)), options.get("field")

    def partitions(self) -> list[Piece]:
        return pieces([{"path": path, "start": a, "size": min(self.size, n - a)} for path, n in _files(self.path) for a in range(0, n, self.size)], self.size)

    def read(self, piece: Piece) -> Iterator[tuple]:
        for p in piece.plans:
            behind = min(BEHIND, p["start"])
            data = read_bytes(p["path"], p["start"] - behind, behind + p["size"])
            for row in summaries(data[:behind], data[behind:], _escaped_before(p["path"], p["start"]), self.field):
                yield (p["path"], p["start"], *row[:4], [dict(zip(("at", "depth", "closes"), a)) for a in row[4]])


class JsonSummaries(DataSource):
    """``json_summaries``: two rows a range of a file, or of each JSON file of a folder. Options: path, rangeBytes, field."""

    @classmethod
    def name(cls) -> str:
        return "json_summaries"

    def schema(self) -> str:
        return SUMMARY

    def reader(self, schema) -> DataSourceReader:
        return _Summaries(self.options)


class _Elements(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.size, self.level, self.plans = int(options["rangebytes"]), int(options["level"]), json.loads(options["plans"])

    def partitions(self) -> list[Piece]:
        return pieces(self.plans, self.size) or [Piece([])]

    def read(self, piece: Piece) -> Iterator[tuple]:
        for p in piece.plans:
            for value in elements(p["path"], p["start"], self.size, p["inside"], p["depth"], p["first"], p["last"], self.level):
                yield p["path"], value


class JsonElements(DataSource):
    """``json_elements``: (path, value) of every element, from the plans that ``true_starts`` made."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Elements(self.options)


def read_json_array(spark: SparkSession, path: str, field: str | None, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects of the array ``field`` of a JSON object, or of a bare array (None), typed by ``schema``.

    ``path`` is a file of any size, or a folder of them, in a file system that the workers reach. Cases: a file without
    the field gives no rows; the field counts at the outermost level only; elements that are no objects are left out,
    and a value that doesn't fit its type is null; blanks between a key and its bracket may take 64 KB.
    """
    for source in (JsonSummaries, JsonElements):
        spark.dataSource.register(source)
    options = {"path": path, "rangeBytes": str(range_bytes)} | ({} if field is None else {"field": field})
    rows = spark.read.format("json_summaries").options(**options).load().collect()  # two small rows a range
    plans = true_starts([r.asDict(recursive=True) for r in rows], field)
    found = spark.read.format("json_elements").options(rangeBytes=str(range_bytes), level=str(1 if field is None else 2), plans=json.dumps(plans)).load()
    return found.where(F.col("value").startswith("{")).select(F.from_json("value", schema).alias("x")).select("x.*")


COCO = {
    "images": "id long, width double, height double, file_name string",
    "annotations": "id long, image_id long, category_id long, bbox array<double>, area double, iscrowd int",
    "categories": "id long, name string",
}


def read_coco_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of COCO files of any size."""
    return tuple(read_json_array(spark, path, name, schema, range_bytes) for name, schema in COCO.items())


TRACKS = "id long, video_id long, category_id long, score double, bboxes array<array<double>>, areas array<double>, iscrowd int"


def read_tracks_ranges(spark: SparkSession, path: str, bare: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Track annotations of files of any size: of ``annotations``, or of a bare array of predicted tracks."""
    return read_json_array(spark, path, None if bare else "annotations", TRACKS, range_bytes)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class _LabelWriter(DataSourceWriter):
    """Each task writes its files to a folder of its own; the driver moves those of committed tasks into place."""

    def __init__(self, path: str) -> None:
        self.path, self.staging = path, f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        system, at = _opened(folder)
        system.create_dir(at, recursive=True)
        names, file = [], None
        for name, line in rows:
            if not names or name != names[-1]:
                if file:
                    file.close()
                names.append(name)
                file = system.open_output_stream(f"{at}/{name}")
            if line is not None:
                file.write(line.encode() + b"\n")
        if file:
            file.close()
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        system, into = _opened(self.path)
        for m in messages:
            if m is not None:
                _, at = _opened(m.folder)
                for name in m.names:
                    if "/" in name:
                        system.create_dir(f"{into}/{name.rsplit('/', 1)[0]}", recursive=True)
                    system.move(f"{at}/{name}", f"{into}/{name}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, at = _opened(self.staging)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class LabelFiles(DataSource):
    """``label_files``: rows (name, line), those of a name adjacent in a partition, as one text file a name."""

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LabelWriter(self.options["path"])


def write_label_files(labels: DataFrame, path: str, name: str = "name", line: str = "line", order: list[str] | None = None) -> None:
    """``labels`` as text files below ``path``: a file a ``name``, its lines in ``order``. Null lines make empty files.

    A name's lines meet in one task, which writes any number of files and holds one line; files appear when all tasks
    have ended, none if the job fails.
    """
    spark = labels.sparkSession
    spark.dataSource.register(LabelFiles)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = labels.where(F.col(name).isNotNull()).repartition(n, F.col(name)).sortWithinPartitions(name, *(order or [line]))
    rows.select(F.col(name).alias("name"), F.col(line).cast("string").alias("line")).write.format("label_files").mode("append").save(path)
