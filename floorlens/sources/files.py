"""Folders of drawing files as Spark data sources, to read in batches or as a stream, and to write.

``register(spark)`` makes the formats known: ``floorlens_dxf`` (entities), ``floorlens_svg`` (primitives) and
``floorlens_documents`` (writes the rows (drawing, value) as files of their own). A task reads the files of one
group, which are listed once, on the driver; options ``kinds``, ``tags``, ``layers`` and ``drawings``
(comma-separated) leave files and rows out before they reach Spark, as do, with the option ``pushdown`` and the
setting ``spark.sql.python.filterPushdown.enabled``, equality filters on these columns. Files are opened through pyarrow, which knows local paths, HDFS, S3 and GCS; on other stores use
``dxf.read_entities`` and ``svg.read_primitives``, which read through Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from . import dxf, svg

#: Bytes of files that a task reads, about.
GROUP_BYTES = 32 << 20

#: Option and column by which rows are left out.
_BY = {"kinds": "kind", "layers": "layer", "drawings": "drawing", "tags": "tag"}


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[tuple[int, str, int]]:
    """(time of the last change, path, bytes) of the folder's files, in that order."""
    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix))


def grouped(files: list[tuple[int, str, int]], most: int = GROUP_BYTES) -> list[list[str]]:
    """Paths in groups of about ``most`` bytes; a larger file stands alone."""
    out: list[list[str]] = []
    total = most
    for _, path, size in files:
        if total + size > most:
            out.append([])
            total = 0
        out[-1].append(path)
        total += size
    return out


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(tuple(paths))


class _Folder:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict, suffix: str, columns: list[str], rows) -> None:
        self.path, self.suffix, self.columns, self.rows = options["path"], suffix, columns, rows
        self.most = int(options.get("groupbytes", options.get("groupBytes", GROUP_BYTES)))
        self.only: dict[str, set] = {c: set(options[o].split(",")) for o, c in _BY.items() if o in options and c in columns}

    def drawing(self, path: str) -> str:
        return path.rpartition("/")[2].removesuffix(self.suffix)

    def wanted(self) -> list[tuple[int, str, int]]:
        files = listed(self.path, self.suffix)
        return [f for f in files if "drawing" not in self.only or self.drawing(f[1]) in self.only["drawing"]]

    def read(self, partition: Files | None) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        system, _ = _system(self.path)
        checks = [(self.columns.index(c), values) for c, values in self.only.items()]
        for path in partition.value:
            with system.open_input_stream(path) as f:
                text = f.readall().decode("utf-8-sig", "replace")
            for row in self.rows(self.drawing(path), text):
                if all(row[i] in values for i, values in checks):
                    yield row


class FolderReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return [Files(g) for g in grouped(self.wanted(), self.most)]


class FilteringReader(FolderReader):
    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in _BY.values():
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            else:
                yield f


class FolderStream(_Folder, DataSourceStreamReader):
    """New files, by the time of their last change; a file must be complete when it appears."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.wanted()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return [Files(g) for g in grouped([f for f in self.wanted() if low < f[:2] <= high], self.most)]

    def commit(self, end: dict) -> None:
        pass


def _dxf_rows(drawing: str, text: str) -> Iterator[tuple]:
    for i, e in enumerate(dxf.drawn_entities(text)):
        yield drawing, i, e.kind, e.layer, e.text, e.radius, e.colour, [tuple(p) for p in e.points]


def _svg_rows(drawing: str, text: str) -> Iterator[tuple]:
    for i, (layer, tag, attrs) in enumerate(svg.primitives_of(text)):
        yield drawing, i, layer, tag, attrs


class _Source(DataSource):
    suffix, columns, rows = "", "", staticmethod(_dxf_rows)

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        kind = FilteringReader if self.options.get("pushdown", "false").lower() == "true" else FolderReader
        return kind(self.options, self.suffix, schema.names, type(self).rows)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FolderStream(self.options, self.suffix, schema.names, type(self).rows)


class DxfFiles(_Source):
    suffix, columns, rows = ".dxf", dxf.DRAWN, staticmethod(_dxf_rows)

    @classmethod
    def name(cls) -> str:
        return "floorlens_dxf"


class SvgFiles(_Source):
    suffix, columns, rows = ".svg", svg.PRIMITIVE, staticmethod(_svg_rows)

    @classmethod
    def name(cls) -> str:
        return "floorlens_svg"


class DocumentWriter(DataSourceWriter):
    """Each row as a file <drawing><suffix>, texts in UTF-8. A task that runs again writes the same files again."""

    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".txt")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{root.rstrip('/')}/{row['drawing']}{self.suffix}") as f:
                value = row["value"]
                f.write(bytes(value) if isinstance(value, bytes | bytearray) else (value or "").encode())
        return WriterCommitMessage()


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "floorlens_documents"

    def schema(self) -> str:
        return "drawing string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (DxfFiles, SvgFiles, DocumentFiles):
        spark.dataSource.register(source)
