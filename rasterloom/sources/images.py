"""Image files: scan, naming, PNG output, reports.

Spark's image source decodes png, jpeg, gif, bmp and tiff; portable pixmaps are read here; files that can't be decoded become error rows. The
source drops the alpha of grey PNG files, which is read from the files themselves. PNG is written band by band: bands are
packed in parallel, and the sink appends them to their files in order.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..model import PIXELS, SUFFIXES
from ..operators.strips import BAND, STRIPS, from_pixels
from ..storage import maybe_broadcast, stored

PNG_START = b"\x89PNG\r\n\x1a\n"
_ADLER = 65521


def plain_path(path: str) -> Column:
    """A path as users write it: local ones without their scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def only_images(files: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path has an image suffix, in any case."""
    return files.where(F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*SUFFIXES))


def list_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, length of a folder's images in path order; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return only_images(reader.load(folder).select("path", "length")).orderBy("path")


def _scan(spark: SparkSession, path: str | list[str], recursive: bool) -> tuple[list[DataFrame], DataFrame]:
    """(rows of the image source that can be unpacked, errors: path and reason)."""
    load = lambda kind: spark.read.format(kind).option("recursiveFileLookup", str(recursive).lower()).load(path)
    place = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  a column, or its name
    # the image source writes paths URL-encoded and local ones with other slashes
    plain = place(F.url_decode(F.replace(F.col("origin"), F.lit("+"), F.lit("%2B"))))
    held = only_images(load("image").select("image.*"), "origin").withColumn("place", plain)
    head = lambda at: F.hex(F.substring("content", at, 1))
    files = only_images(load("binaryFile").select(place("path").alias("place"), "content"), "place")
    grey_png = (F.hex(F.substring("content", 1, 8)) == PNG_START.hex().upper()) & (head(26) == "04")
    is_map = F.lower("place").endswith(".ppm")
    special = stored(files.select("place", F.when(is_map, "map").when(grey_png, "grey").alias("kind")).where("kind is not null"), "special")
    kinds = {r["kind"] for r in special.select("kind").distinct().collect()}
    rest = held
    if kinds:  # else every picture is decoded once, and no file is looked at again
        rest = held.join(maybe_broadcast(special.select("place")), "place", "left_anti")
    good, bad = [rest.where("height > 0")], rest.where("height <= 0").select("place")
    if "grey" in kinds:
        grey = held.join(maybe_broadcast(special.where("kind = 'grey'").select("place")), "place", "left_semi")
        good.append(grey.where("height > 0").join(files.where(grey_png), "place"))
        bad = bad.unionByName(grey.where("height <= 0").select("place"))
    if "map" in kinds:
        maps = files.where(is_map).select(F.col("place").alias("origin"), "place", _read_ppm("content").alias("p")).select("origin", "place", "p.*")
        good.append(maps.where("data is not null"))
        bad = bad.unionByName(maps.where("data is null").select("place"))
    return good, bad.select(F.col("place").alias("path"), F.lit("can't be decoded").alias("reason"))


@F.pandas_udf(T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("height", "width", "nChannels")), T.StructField("data", T.BinaryType())]))
def _read_ppm(files: pd.Series) -> pd.DataFrame:
    """Portable pixmaps (P6, P5 and their plain forms P3, P2) as rows of the image source; null data for what isn't one."""
    return pd.DataFrame([_ppm(bytes(f)) for f in files], columns=["height", "width", "nChannels", "data"])


def _ppm(raw: bytes) -> tuple[int, int, int, bytes | None]:
    head = re.match(rb"(P[2356])" + 3 * rb"(?:\s|#[^\n]*\n)+(\d+)" + rb"\s", raw)
    if not head:
        return 0, 0, 0, None
    w, h, top = (int(v) for v in head.groups()[1:])
    n, plain = 3 if head[1] in (b"P3", b"P6") else 1, head[1] in (b"P2", b"P3")
    if plain:
        values = np.array(re.sub(rb"#[^\n]*", b"", raw[head.end() :]).split(), np.int64)
    else:
        values = np.frombuffer(raw[head.end() :], np.uint8 if top < 256 else ">u2", count=-1 if top < 256 else (len(raw) - head.end()) // 2).astype(np.int64)
    if not (0 < top < 65536 and w and h and len(values) >= h * w * n):
        return 0, 0, 0, None
    level = (values[: h * w * n] * 255 + top // 2) // top
    return h, w, n, np.minimum(level, 255).astype(np.uint8).reshape(-1, n)[:, ::-1].tobytes()


def read_images(spark: SparkSession, path: str | list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pixels, errors): pixels keyed by the file's path; errors has path and reason of each file that could not be decoded."""
    found, errors = _scan(spark, path, recursive)
    return reduce(DataFrame.unionByName, map(unpack, found)), errors


def read_strips(spark: SparkSession, path: str | list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(strips, errors): the same in strips of packed rows, keyed by the plain path."""
    found, errors = _scan(spark, path, recursive)
    return reduce(DataFrame.unionByName, (unpack_strips(f.withColumn("origin", F.col("place"))) for f in found)), errors


def _png_parts(png: bytes) -> tuple[bytes, bytes]:
    """The header and the unpacked lines of a PNG file."""
    at, body, head = 8, [], b""
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        if kind == b"IHDR":
            head = png[at + 8 : at + 8 + n]
        elif kind == b"IDAT":
            body.append(png[at + 8 : at + 8 + n])
        at += n + 12
    return head, zlib.decompress(b"".join(body))


#: First row and column, and steps, of the seven passes of an interlaced PNG.
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def grey_alpha(png: bytes) -> np.ndarray:
    """Alpha, one byte a pixel in picture order, of a grey PNG with alpha."""
    head, raw = _png_parts(png)
    w, h, depth = struct.unpack(">IIB", head[:9])
    step, out, at = depth // 4, np.empty((h, w), np.uint8), 0
    for y0, x0, dy, dx in _PASSES if head[12] else ((0, 0, 1, 1),):
        part = out[y0::dy, x0::dx]
        if part.size:
            size = part.shape[0] * (1 + part.shape[1] * step)
            part[:] = _unfiltered(np.frombuffer(raw, np.uint8, size, at).reshape(part.shape[0], -1), step)[:, :, step // 2]
            at += size
    return out.ravel()


def _unfiltered(packed: np.ndarray, step: int) -> np.ndarray:
    """(rows, pixels, step) bytes of lines that begin with the number of their filter."""
    w = (packed.shape[1] - 1) // step
    above, out = np.zeros((w, step), np.uint8), np.empty((len(packed), w, step), np.uint8)
    for y, (kind, line) in enumerate(zip(packed[:, 0], packed[:, 1:].reshape(-1, w, step))):
        if kind == 1:
            line = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            line = line + above
        elif kind > 2:
            line = np.array([_along(c.tolist(), up.tolist(), kind == 4) for c, up in zip(line.T, above.T)], np.uint8).T
        out[y] = above = line
    return out


def _along(line: list[int], up: list[int], paeth: bool) -> list[int]:
    """One channel of a line whose filter needs both the pixel before and the line above."""
    left = corner = 0
    for x, b in enumerate(up):
        if paeth:
            guess = min((left, b, corner), key=lambda v: abs(left + b - corner - v))
        else:
            guess = (left + b) // 2
        left = line[x] = (line[x] + guess) & 255
        corner = b
    return line


def _rgba(h: int, w: int, n: int, data: bytes, content: bytes | None, y0: int, y1: int, alpha: np.ndarray | None) -> np.ndarray:
    """(rows, w, 4) bytes of rows y0 to y1 of a row of the image source (BGR or BGRA bytes, or grey)."""
    raw = np.frombuffer(data, np.uint8).reshape(h, w, n)[y0:y1]
    out = np.full((len(raw), w, 4), 255, np.uint8)
    out[..., :3] = raw[..., 2::-1] if n >= 3 else raw
    if n == 4 or alpha is not None:
        out[..., 3] = raw[..., 3] if n == 4 else alpha.reshape(h, w)[y0:y1]
    return out


def _decoded(images: DataFrame) -> DataFrame:
    content = F.col("content") if "content" in images.columns else F.lit(None).cast("binary").alias("content")
    return images.select("origin", "height", "width", "nChannels", "data", content)


def unpack(images: DataFrame) -> DataFrame:
    """Pixels of rows of the image source and, where grey has an alpha, the file in `content`; in chunks of rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for origin, h, w, n, data, content in batch.itertuples(index=False):
                alpha = grey_alpha(content) if n == 1 and content is not None else None
                step = max(1, 200_000 // w)
                for y0 in range(0, h, step):
                    part = _rgba(h, w, n, data, content, y0, y0 + step, alpha).reshape(-1, 4).astype(np.int32)
                    y, x = divmod(np.arange(y0 * w, y0 * w + len(part), dtype=np.int32), w)
                    yield pd.DataFrame({"image_id": origin, "y": y, "x": x, **dict(zip("rgba", part.T))})

    return _decoded(images).mapInPandas(work, PIXELS)


def unpack_strips(images: DataFrame) -> DataFrame:
    """The same rows as strips of packed rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for origin, h, w, n, data, content in batch.itertuples(index=False):
                alpha = grey_alpha(content) if n == 1 and content is not None else None
                for band in range(-(-h // BAND)):
                    part = _rgba(h, w, n, data, content, band * BAND, (band + 1) * BAND, alpha)
                    yield pd.DataFrame({"image_id": [origin], "band": [band], "h": [h], "w": [w], "data": [part.tobytes()]})

    return _decoded(images).mapInPandas(work, STRIPS)


def output_path(path: Column, suffix: str = "-clean", out_dir: str | None = None) -> Column:
    """stem + suffix + .png, beside the source or in out_dir."""
    named = F.regexp_replace(path, r"\.[^./]*$", f"{suffix}.png")
    return named if out_dir is None else F.concat(F.lit(out_dir.rstrip("/") + "/"), F.regexp_extract(named, "[^/]*$", 0))


def not_yet_done(files: DataFrame, existing: DataFrame, suffix: str = "-clean", out_dir: str | None = None) -> DataFrame:
    """files less those whose output stands in `existing` (path)."""
    there = existing.select(F.col("path").alias("target"))
    return files.withColumn("target", output_path(F.col("path"), suffix, out_dir)).join(there, "target", "left_anti")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _join_adler(one: int, two: int, length: int) -> int:
    """The checksum of two texts in a row, the second `length` bytes long."""
    a1, b1, a2, b2 = one & 0xFFFF, one >> 16, two & 0xFFFF, two >> 16
    return (b1 + b2 + length * (a1 - 1)) % _ADLER << 16 | (a1 + a2 - 1) % _ADLER


def png_bands(strips: DataFrame) -> DataFrame:
    """image_id, band, h, w, opaque, body, adler, n: each strip's lines deflated, for files of RGB (if every alpha of the picture is 255) or RGBA. strips: a stored table."""

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"image_id": batch["image_id"], "low": [int(np.frombuffer(d, np.uint8)[3::4].min(initial=255)) for d in batch["data"]]})

    facts = strips.select("image_id", "data").mapInPandas(lowest, "image_id string, low int").groupBy("image_id").agg((F.min("low") == 255).alias("opaque"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, band, h, w, data, opaque in batch.itertuples(index=False):
                rgba = np.frombuffer(data, np.uint8).reshape(-1, w, 4)
                n = 3 if opaque else 4
                lines = np.zeros((len(rgba), 1 + w * n), np.uint8)
                lines[:, 1:] = rgba[..., :n].reshape(len(rgba), -1)
                raw, packer = lines.tobytes(), zlib.compressobj(6, zlib.DEFLATED, -15)
                body = packer.compress(raw) + packer.flush(zlib.Z_FINISH if (band + 1) * BAND >= h else zlib.Z_FULL_FLUSH)
                yield pd.DataFrame({"image_id": [image_id], "band": [band], "h": [h], "w": [w], "opaque": [opaque], "body": [body], "adler": [zlib.adler32(raw)], "n": [len(raw)]})

    held = strips.join(maybe_broadcast(stored(facts, "opaque")), "image_id").select("image_id", "band", "h", "w", "data", "opaque")
    return held.mapInPandas(pack, "image_id string, band int, h int, w int, opaque boolean, body binary, adler long, n long")


def _png_head(w: int, h: int, opaque: bool) -> bytes:
    return PNG_START + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if opaque else 6, 0, 0, 0))


def encode_png(pixels: DataFrame) -> DataFrame:
    """image_id, png: whole files, for pictures whose file fits a row (larger ones: save_strips). pixels: a dense grid."""

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part, total = part.sort_values("band"), 1
        for adler, n in zip(part["adler"], part["n"]):
            total = _join_adler(total, int(adler), int(n))
        first = part.iloc[0]
        bodies = [b"\x78\x9c", *part["body"], struct.pack(">I", total)]
        png = _png_head(first["w"], first["h"], first["opaque"]) + b"".join(_chunk(b"IDAT", b) for b in bodies) + _chunk(b"IEND", b"")
        return pd.DataFrame({"image_id": [first["image_id"]], "png": [png]})

    return png_bands(stored(from_pixels(pixels), "strips")).groupBy("image_id").applyInPandas(join, "image_id string, png binary")


def decode_png(files: DataFrame) -> DataFrame:
    """Pixels of (image_id, png) rows as encode_png writes them: 8 bits, unfiltered lines. Other files go through read_images."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, png in batch.itertuples(index=False):
                head, raw = _png_parts(png)
                w, h, _, kind = struct.unpack(">IIBB", head[:10])
                n = 4 if kind == 6 else 3
                lines = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * n)
                if lines[:, 0].any():
                    raise ValueError(f"{image_id}: filtered lines")
                flat = lines[:, 1:].reshape(h * w, n).astype(np.int32)
                y, x = divmod(np.arange(h * w, dtype=np.int32), w)
                yield pd.DataFrame({"image_id": image_id, "y": y, "x": x, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2], "a": flat[:, 3] if n == 4 else 255})

    return files.select("image_id", "png").mapInPandas(work, PIXELS)


def _folder(path: str):
    """(file system, root) of a folder by its URI or local path, made if need be."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{quote(path)}")
    store.create_dir(root, recursive=True)
    return store, root


class _FolderWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        store, root = _folder(self.path)
        for row in rows:
            store.create_dir(f"{root}/{row.name}".rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{root}/{row.name}") as out:
                out.write(row.content)
        return WriterCommitMessage()


class _BandWriter(DataSourceWriter):
    """Appends a picture's bands, which come in order, to its file; the file gets its name when it is whole."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        store, root = _folder(self.path)
        for name, bands in groupby(rows, key=lambda r: r.name):
            place, total = f"{root}/{name}", 1
            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{place}.part") as out:
                for i, b in enumerate(bands):
                    if not i:
                        out.write(_png_head(b.w, b.h, b.opaque) + _chunk(b"IDAT", b"\x78\x9c"))
                    out.write(_chunk(b"IDAT", bytes(b.body)))
                    total = _join_adler(total, b.adler, b.n)
                out.write(_chunk(b"IDAT", struct.pack(">I", total)) + _chunk(b"IEND", b""))
            store.move(f"{place}.part", place)
        return WriterCommitMessage()


class PngBands(DataSource):
    """Sink `png_bands`: rows in order of (name, band) within each partition become files; no picture's bytes meet in one row or in memory."""

    @classmethod
    def name(cls) -> str:
        return "png_bands"

    def schema(self) -> str:
        return "name string, band int, h int, w int, opaque boolean, body binary, adler long, n long"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BandWriter(self.options["path"])


class FileFolder(DataSource):
    """Sink `files`: each row (name, content) becomes a file of the folder in `path`; a task that runs again writes the same files again."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FolderWriter(self.options["path"])


def file_stems(pictures: DataFrame) -> DataFrame:
    """image_id, stem: the last part of the image_id without its suffix, and with a hash of the image_id behind it where several pictures share that part."""
    stem = F.regexp_replace(F.regexp_extract("image_id", "[^/]*$", 0), r"\.[^.]*$", "")
    named = pictures.select("image_id").distinct().withColumn("stem", stem)
    shared = named.groupBy("stem").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    apart = F.concat("stem", F.lit("-"), F.substring(F.md5("image_id"), 1, 8))
    return named.join(shared, "stem", "left").select("image_id", F.when(F.col("_n").isNull(), F.col("stem")).otherwise(apart).alias("stem"))


def save_strips(strips: DataFrame, names: DataFrame, folder: str) -> None:
    """One PNG a picture. strips: a stored table; names: image_id, name (of the file, within the folder)."""
    strips.sparkSession.dataSource.register(PngBands)
    named = png_bands(strips).join(names, "image_id").select("name", "band", "h", "w", "opaque", "body", "adler", "n")
    named.repartition("name").sortWithinPartitions("name", "band").write.format("png_bands").mode("append").save(folder)


def save_images(pixels: DataFrame, folder: str, suffix: str = "") -> None:
    """One PNG per picture, named by file_stems."""
    strips = stored(from_pixels(pixels), "strips")
    save_strips(strips, file_stems(strips).select("image_id", F.concat("stem", F.lit(f"{suffix}.png")).alias("name")), folder)


def report_json(info: DataFrame, metrics: DataFrame) -> DataFrame:
    """image_id and the report {info, metrics} as JSON."""
    left = info.select("image_id", F.struct(*[c for c in info.columns if c != "image_id"]).alias("info"))
    right = metrics.select("image_id", F.struct(*[c for c in metrics.columns if c != "image_id"]).alias("metrics"))
    return left.join(right, "image_id").select("image_id", F.to_json(F.struct("info", "metrics"), {"pretty": "true"}).alias("report"))


def save_files(files: DataFrame, folder: str) -> None:
    """files: name (within the folder) and content."""
    files.sparkSession.dataSource.register(FileFolder)
    files.write.format("files").mode("append").save(folder)


def save_reports(reports: DataFrame, folder: str) -> None:
    """One JSON file per picture, `<stem>-report.json`."""
    rows = reports.join(file_stems(reports), "image_id").select(F.concat("stem", F.lit("-report.json")).alias("name"), F.col("report").cast("binary").alias("content"))
    save_files(rows, folder)
