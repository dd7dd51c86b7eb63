"""Landed feed files (rss and atom) as a data source, for batches and streams alike.

    spark.dataSource.register(LandedFeeds)
    spark.read.format("landed_feeds").load(folder)
    spark.readStream.format("landed_feeds").option("maxFiles", 100).load(folder)

A row for each item: file, item (its number in the file), title, link, description, summary, reason. A file that cannot
be read as xml gives one row with the reason and nothing else, so that nothing is lost silently. A file is parsed as a stream:
a task holds one item at a time, however large its files are. Files are dealt to tasks by size. A stream's offset is the last file taken, in order of landing (time, then name): a file lands by a rename into
the folder, and one that changes afterwards is taken again as a new landing. What is read belongs to offsets alone, so a
restart reads nothing twice and nothing less.

Folders are paths or uris of file systems that pyarrow knows (file, hdfs, s3, gs). Names that begin with _ or . are
left out. Files with other endings than .xml, .rss and .atom (option endings, comma-joined) are no feeds.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, item int, title string, link string, description string, summary string, reason string"
ENDINGS = (".xml", ".rss", ".atom")
ITEMS = ("item", "entry")
#: Bytes of files that a task reads, and files that a batch of a stream takes, unless options (taskBytes, maxFiles) say otherwise.
TASK_BYTES, MAX_FILES = 32 << 20, 1000


@dataclass
class Files(InputPartition):
    paths: list[str]


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:/") else (fs.LocalFileSystem(), folder)


def listed(folder: str, endings: tuple[str, ...] = ENDINGS) -> list[tuple[int, str, int]]:
    """(time of landing, path, bytes) of the folder's feed files, in that order."""
    from pyarrow import fs

    system, path = _system(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and f.base_name.lower().endswith(endings) and f.base_name[0] not in "._")


def dealt(files: list[tuple[int, str, int]], task_bytes: int) -> list[Files]:
    out, size = [], 0
    for _, path, n in files:
        if not out or size + n > task_bytes:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(path)
        size += n
    return out


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _text(element) -> str:
    return "".join(element.itertext())


def _item(path: str, k: int, e) -> tuple:
    own: dict[str, str] = {}
    for c in e:
        name = _plain(c.tag)
        value = (c.get("href") or _text(c)) if name == "link" else _text(c)
        if name == "link" and c.get("rel", "alternate") != "alternate":
            continue
        own.setdefault(name, value.strip() if name == "link" else value)
    return path, k, own.get("title"), own.get("link"), own.get("description") or own.get("content") or own.get("encoded"), own.get("summary"), None


def _outermost(file) -> Iterator:
    """The items of a feed that lie in no other, each with all below it; at last the root's tag. What has been given, and what lies
    outside of items, is let go, so that one item is held at a time."""
    open_, inside, root = [], 0, None
    for event, e in ET.iterparse(file, ("start", "end")):
        item = _plain(e.tag) in ITEMS
        if event == "start":
            root = e.tag if root is None else root
            open_.append(e)
            inside += item
            continue
        open_.pop()
        inside -= item
        if inside:
            continue
        if item:
            yield e
        e.clear()
        if open_:
            open_[-1].clear()
    yield root


def rows_of(path: str, opened) -> Iterator[tuple]:
    """Rows of a feed file: rss items and atom entries. opened() opens it; it is read twice, first to see that it is whole,
    as a bad file gives no items."""
    n, root = 0, ""
    try:
        with opened() as f:
            for x in _outermost(f):
                if isinstance(x, str):
                    root = _plain(x)
                else:
                    n += 1
        if not n and root not in ("rss", "feed", "rdf"):
            yield path, None, None, None, None, None, f"no feed: {root}"
    except (ET.ParseError, ValueError, LookupError) as e:
        yield path, None, None, None, None, None, f"no xml: {e}"
        return
    except OSError as e:
        yield path, None, None, None, None, None, f"not readable: {type(e).__name__}"
        return
    if not n:
        return
    k = 0
    with opened() as f:
        for x in _outermost(f):
            for e in x.iter() if not isinstance(x, str) else ():
                if _plain(e.tag) in ITEMS:
                    yield _item(path, k, e)
                    k += 1


def read_files(folder: str, part: Files) -> Iterator[tuple]:
    system, _ = _system(folder)
    for path in part.paths:
        yield from rows_of(path, lambda path=path: system.open_input_stream(path))


def _endings(options) -> tuple[str, ...]:
    return tuple(options["endings"].split(",")) if "endings" in options else ENDINGS


class LandedFeeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.task_bytes, self.endings = options["path"], int(options.get("taskBytes", TASK_BYTES)), _endings(options)

    def partitions(self):
        return dealt(listed(self.folder, self.endings), self.task_bytes) or [Files([])]

    def read(self, partition) -> Iterator[tuple]:
        yield from read_files(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets: {time, path} of the last file taken; before the first, time -1."""

    def __init__(self, options):
        self.folder, self.task_bytes, self.most = options["path"], int(options.get("taskBytes", TASK_BYTES)), int(options.get("maxFiles", MAX_FILES))
        self.endings, self.at = _endings(options), None

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _after(self, start: dict):
        return [f for f in listed(self.folder, self.endings) if f[:2] > (start["time"], start["path"])]

    def latestOffset(self) -> dict:
        new = self._after(self.at or self.initialOffset())[: self.most]
        if new:
            self.at = {"time": new[-1][0], "path": new[-1][1]}
        return self.at or self.initialOffset()

    def partitions(self, start: dict, end: dict):
        self.at = end
        return dealt([f for f in self._after(start) if f[:2] <= (end["time"], end["path"])], self.task_bytes)

    def read(self, partition) -> Iterator[tuple]:
        yield from read_files(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


def feed_items(spark: SparkSession, folder: str, stream: bool = False, **options) -> DataFrame:
    """The rows of SCHEMA of a folder of feeds, as a batch or a stream."""
    spark.dataSource.register(LandedFeeds)
    r = (spark.readStream if stream else spark.read).format("landed_feeds")
    return r.options(**options).load(folder)


def candidates_of(items: DataFrame, feed: str = "") -> DataFrame:
    """Candidates (url, title, snippet, source_type, source_feed) of feed items; items without a link and bad files go."""
    from veriscope.functions import text as X
    from veriscope.sources.readers import snippet

    ok: Column = F.col("reason").isNull() & (F.coalesce("link", F.lit("")) != "")
    return items.where(ok).select(X.normalise_url(F.col("link")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), snippet(F.col("summary"), F.col("description")).alias("snippet"), F.lit("rss").alias("source_type"), F.lit(feed).alias("source_feed"))


def bad_files(items: DataFrame) -> DataFrame:
    return items.where("reason is not null").select("file", "reason")
