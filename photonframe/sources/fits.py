"""FITS headers and pixels as tables, and a writer.

Files are listed by Spark's binaryFile reader. Headers are read block by block through streams (pyarrow's file systems: local, HDFS, object stores), so
that a header costs a few kilobytes whatever the file's size; paths of other schemes, and pixels, come through Spark's reader whole. The image sink writes
under the attempt's own folder and moves files into place when the whole job commits.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK, CARD, TILE = 2880, 80, 256
SUFFIXES = "*.{fit,fits,fts,FIT,FITS,FTS}"
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
HEADER_SCHEMA = "path string, cards map<string,string>, bitpix int, naxis int, naxis1 int, naxis2 int, naxis3 int, bzero double, bscale double, skip_reason string"
TILE_SCHEMA = "path string, ch int, ty int, tx int, y0 int, x0 int, h int, w int, data binary"
_CARD = re.compile(r"^([A-Z0-9_-]{1,8}) *= *(?:'((?:[^']|'')*)'|([^/]*))")


def parse_header(data: bytes) -> tuple[dict[str, str], int]:
    """Cards and the offset of what follows the header; a header without END raises ValueError."""
    cards: dict[str, str] = {}
    for at in range(0, len(data) - CARD + 1, CARD):
        card = data[at : at + CARD].decode("latin-1")
        if card.rstrip() == "END":
            return cards, -(-(at + CARD) // BLOCK) * BLOCK
        if m := _CARD.match(card):
            cards[m[1]] = m[2].replace("''", "'").rstrip() if m[2] is not None else m[3].strip()
    raise ValueError("no END card")


def header_row(path: str, data: bytes) -> dict:
    """A row of HEADER_SCHEMA; what cannot be read has a skip_reason."""
    row = dict.fromkeys(("cards", "bitpix", "naxis", "naxis1", "naxis2", "naxis3", "bzero", "bscale", "skip_reason"))
    row["path"] = path
    try:
        cards, _ = parse_header(data)
        row["cards"] = cards
        for k in ("bitpix", "naxis", "naxis1", "naxis2", "naxis3"):
            row[k] = int(cards[k.upper()]) if k.upper() in cards else None
        row["bzero"], row["bscale"] = float(cards.get("BZERO", 0)), float(cards.get("BSCALE", 1))
    except ValueError as e:
        row["skip_reason"] = f"unreadable: {e}"
    return row


def decode(data: bytes) -> np.ndarray:
    """Pixels as float32 (channel, y, x)."""
    cards, at = parse_header(data)
    naxis = int(cards["NAXIS"])
    shape = [int(cards[f"NAXIS{k}"]) for k in range(naxis, 0, -1)]
    kind = np.dtype(TYPES[int(cards["BITPIX"])])
    raw = np.frombuffer(data, kind, count=int(np.prod(shape)), offset=at).astype(np.float64)
    out = (raw * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))).astype(np.float32)
    return out.reshape((1, *shape) if naxis == 2 else shape)


def encode(pixels: np.ndarray, cards: dict[str, str] | None = None) -> bytes:
    """A FITS file of float32 pixels (y, x) or (channel, y, x)."""
    shape = pixels.shape[::-1]
    fixed = {"SIMPLE": "T", "BITPIX": "-32", "NAXIS": str(pixels.ndim)} | {f"NAXIS{i + 1}": str(n) for i, n in enumerate(shape)}
    lines = [f"{k:<8}= {v:>20}" for k, v in fixed.items()]
    for k, v in (cards or {}).items():
        if k not in fixed and k not in ("BZERO", "BSCALE", "EXTEND", "END"):
            number = re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|[TF]", v)
            lines.append(f"{k:<8}= {v:>20}" if number else f"{k:<8}= '{v.replace(chr(39), chr(39) * 2):<8}'")
    head = "".join(f"{x:<80}"[:80] for x in [*lines, "END"]).encode("latin-1", "replace")
    body = pixels.astype(">f4").tobytes()
    return head + b" " * (-len(head) % BLOCK) + body + b"\0" * (-len(body) % BLOCK)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).option("recursiveFileLookup", "true").load(path)


#: Schemes that pyarrow opens as streams; a path without one, or with "file", is local.
STREAMS = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")
#: Files whose headers one task reads.
FILES_PER_TASK = 256
#: Blocks of the longest header that is looked for (28 MB): a file without an END card is unreadable, not read whole.
LONGEST = 10_000


def scheme(path: str) -> str:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return m[1].lower() if m else "file"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path, and the path there. Spark writes local paths as "file:/a" or "file:///a", with plain names."""
    if scheme(path) == "file":
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:(//(?=/))?", "", path)
    return pyarrow.fs.FileSystem.from_uri(path)


def header_blocks(path: str) -> bytes:
    """The blocks of a file up to the one with the END card; all there is, where there is none within `LONGEST` blocks."""
    return _blocks(*opened(path))


def _blocks(system: pyarrow.fs.FileSystem, name: str) -> bytes:
    data = bytearray()
    with system.open_input_stream(name, buffer_size=4 * BLOCK) as f:
        while len(data) < LONGEST * BLOCK and (block := f.read(BLOCK)):
            data += block
            if any(block[i : i + CARD].rstrip() == b"END" for i in range(0, len(block), CARD)):
                break
    return bytes(data)


def streamed_row(path: str) -> dict:
    """The header's row; a file that cannot be opened has a skip_reason."""
    system, name = opened(path)
    try:
        return header_row(path, _blocks(system, name))
    except OSError as e:
        return header_row(path, b"") | {"skip_reason": f"unreadable: {e}"}


def _listed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{**r, "cards": list(r["cards"].items()) if r["cards"] is not None else None} for r in rows], schema=_HEADER_ARROW)


def read_headers(spark: SparkSession, path: str, streamed: bool | None = None) -> DataFrame:
    """A row of HEADER_SCHEMA for every FITS file under `path`. Where the scheme can be streamed only the header's blocks are read: the listing holds
    no content, and its paths are dealt evenly over tasks; elsewhere, or with `streamed` false, files come whole. A file that cannot be opened has a
    skip_reason; a file system that pyarrow lacks a library for is an error."""
    listed = _files(spark, path)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _listed([header_row(p.as_py(), c.as_py()) for p, c in zip(batch.column(0), batch.column(1), strict=True)])

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _listed([streamed_row(p.as_py()) for p in batch.column(0)])

    if streamed is None:
        # A path without a scheme lies where Hadoop's default says.
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        streamed = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() in STREAMS
    if not streamed:
        return listed.select("path", "content").mapInArrow(whole, HEADER_SCHEMA)
    paths = listed.select("path")
    # The reader packs files into tasks by their bytes; headers cost alike whatever the size.
    return paths.repartition(max(1, -(-paths.count() // FILES_PER_TASK)), "path").mapInArrow(streams, HEADER_SCHEMA)


_HEADER_ARROW = pa.schema(
    [("path", pa.string()), ("cards", pa.map_(pa.string(), pa.string()))] + [(k, pa.int32()) for k in ("bitpix", "naxis", "naxis1", "naxis2", "naxis3")] + [("bzero", pa.float64()), ("bscale", pa.float64()), ("skip_reason", pa.string())]
)


def tile_rows(path: str, pixels: np.ndarray, size: int = TILE) -> Iterator[dict]:
    """Rows of TILE_SCHEMA of an image (channel, y, x)."""
    for ch in range(pixels.shape[0]):
        for y0 in range(0, pixels.shape[1], size):
            for x0 in range(0, pixels.shape[2], size):
                part = np.ascontiguousarray(pixels[ch, y0 : y0 + size, x0 : x0 + size], np.float32)
                yield {"path": path, "ch": ch, "ty": y0 // size, "tx": x0 // size, "y0": y0, "x0": x0, "h": part.shape[0], "w": part.shape[1], "data": part.tobytes()}


_TILE_ARROW = pa.schema([("path", pa.string())] + [(k, pa.int32()) for k in ("ch", "ty", "tx", "y0", "x0", "h", "w")] + [("data", pa.binary())])


def read_tiles(spark: SparkSession, path: str, size: int = TILE) -> DataFrame:
    """Tiles (float32) of every readable FITS file under `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    pixels = decode(c.as_py())
                except (ValueError, KeyError):
                    continue
                yield pa.RecordBatch.from_pylist(list(tile_rows(p.as_py(), pixels, size)), schema=_TILE_ARROW)

    return _files(spark, path).select("path", "content").mapInArrow(run, TILE_SCHEMA)


def pixels_of(tiles: DataFrame) -> DataFrame:
    """Tiles as a long table (path, ch, y, x, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                y, x = np.mgrid[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]]
                n = r["h"] * r["w"]
                v = np.frombuffer(r["data"], np.float32).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), pa.array(np.full(n, r["ch"], np.int32)), pa.array(y.ravel().astype(np.int32)), pa.array(x.ravel().astype(np.int32)), pa.array(v)], ["path", "ch", "y", "x", "v"])

    return tiles.select(*TILE_SCHEMA.replace(" string", "").replace(" int", "").replace(" binary", "").split(", ")).mapInArrow(run, "path string, ch int, y int, x int, v double")


class HeaderSource(DataSource):
    """spark.read.format("fits_header").option("path", folder): header blocks only, through streams of any scheme of `STREAMS`."""

    @classmethod
    def name(cls) -> str:
        return "fits_header"

    def schema(self) -> str:
        return HEADER_SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.batch = options["path"], int(options.get("filesPerPartition", FILES_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        system, folder = opened(self.root)
        ends = tuple(s.lower() for s in (".fit", ".fits", ".fts"))
        found = sorted(i.path for i in system.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True)) if i.is_file and i.path.lower().endswith(ends))
        # Other schemes' paths come without scheme and host.
        base = "" if scheme(self.root) == "file" else self.root[: len(self.root.rstrip("/")) - len(folder.rstrip("/"))]
        return [_Files([base + p for p in found[i : i + self.batch]]) for i in range(0, len(found), self.batch)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            r = streamed_row(path)
            yield tuple(r[k] for k in ("path", "cards", "bitpix", "naxis", "naxis1", "naxis2", "naxis3", "bzero", "bscale", "skip_reason"))


class ImageSink(DataSource):
    """df.write.format("fits_image").mode("append").save(folder): rows (name, cards, shape, data float32) become files. Tasks write below a folder of
    the job; its commit moves the files of the attempts that succeeded into place, so that failed and repeated attempts leave nothing behind."""

    @classmethod
    def name(cls) -> str:
        return "fits_image"

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    """What an attempt wrote: its folder and the names in it."""

    folder: str
    names: list[str]


class ImageWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, root = opened(self.path)
        task = TaskContext.get()
        folder = f"{root}/{self.job}/{task.partitionId() if task else 0}-{task.taskAttemptId() if task else 0}"
        system.create_dir(folder, recursive=True)
        names = []
        for r in rows:
            name = posixpath.basename(r.name)
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write(encode(np.frombuffer(r.data, np.float32).reshape(tuple(r.shape)), dict(r.cards or {})))
            names.append(name)
        return Written(folder, sorted(set(names)))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{m.folder}/{name}", f"{root}/{name}")
        system.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == pyarrow.fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


def register(spark: SparkSession) -> None:
    """Makes the formats "fits_header" and "fits_image" known."""
    spark.dataSource.register(HeaderSource)
    spark.dataSource.register(ImageSink)


def frame_rows(headers: DataFrame) -> DataFrame:
    """Frames of headers: typed fields with fallbacks to the file name, and the first reason to skip a file."""
    from photonframe.functions import text

    name = F.element_at(F.split("path", "/"), -1)
    parts = text.frame_name(name)
    card = lambda k: F.nullif(F.trim(F.try_element_at("cards", F.lit(k))), F.lit(""))
    number = lambda *ks: F.coalesce(*(F.expr(f"try_cast(cards['{k}'] as double)") for k in ks))
    bare = F.regexp_replace(F.lower(name), "^failed_", "")
    kind = F.lower(F.coalesce(card("IMAGETYP"), card("FRAME"), F.lit("light")))
    skip = (
        F.when(bare.rlike("^(dark|flat|bias|offset)"), "calibration file")
        .when(bare.rlike("^(stack|master|img_|pp_|r_pp_|bkg_)") | bare.contains("thumbnail"), "derived product")
        .when(F.col("skip_reason").isNotNull(), F.col("skip_reason"))
        .when(F.coalesce("naxis", F.lit(0)) != 2, "not a raw frame")
        .when(~kind.contains("light"), "not a light frame")
        .when(F.coalesce(number("RESTACK"), F.lit(0.0)) != 0, "restacked")
    )
    return headers.select(
        "path", name.alias("name"), text.norm(F.coalesce(card("OBJECT"), parts["target"])).alias("object"), text.norm(F.coalesce(card("FILTER"), parts["filter"])).alias("filter"),
        F.coalesce(number("EXPTIME", "EXPOSURE"), parts["exptime"]).alias("exptime"), F.coalesce(number("GAIN"), parts["gain"]).alias("gain"), F.coalesce(number("XBINNING"), F.lit(1.0)).cast("int").alias("binning"),
        F.coalesce(number("CCD-TEMP", "DET-TEMP", "SET-TEMP"), parts["temp"]).alias("temp"), card("BAYERPAT").alias("bayer"), F.col("naxis1").alias("width"), F.col("naxis2").alias("height"),
        F.coalesce(F.expr("unix_timestamp(try_to_timestamp(replace(cards['DATE-OBS'], 'Z', '')))").cast("double"), F.lit(0.0)).alias("time"), F.coalesce(parts["device_rejected"], F.lit(False)).alias("device_rejected"), skip.alias("skip_reason"),
    )
