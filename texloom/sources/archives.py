"""Sources: archives of projects, batch lists, dependency records and control files."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FILES, MOST_BYTES, MOST_OF_ONE = 4000, 300_000_000, 80_000_000
CHARSETS = ("utf-8-sig", "gb18030", "cp1252", "latin-1")


class Refused(ValueError):
    """Why an archive is not read."""


def decode(blob: bytes) -> str:
    """SC3: the first character set that fits; the last one fits every byte."""
    for charset in CHARSETS:
        try:
            return blob.decode(charset)
        except UnicodeDecodeError:
            continue
    raise AssertionError


def safe(name: str) -> bool:
    """SC4."""
    parts = name.replace("\\", "/").split("/")
    return not (name.startswith(("/", "\\")) or ".." in parts or ":" in name or "\0" in name)


def _bounded(stream, size: int) -> bytes:
    blob = stream.read(size + 1)
    if len(blob) > size:
        raise Refused("too_large")
    return blob


def _entries(blob: bytes) -> Iterator[tuple[str, bytes]]:
    if blob[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(blob)) as z:
            for e in z.infolist():
                if (e.external_attr >> 16) & 0o170000 == 0o120000:
                    raise Refused("link")
                if not e.is_dir():
                    with z.open(e) as stream:
                        yield e.filename, _bounded(stream, MOST_OF_ONE)
        return
    try:
        tar = tarfile.open(fileobj=io.BytesIO(blob))
    except tarfile.TarError:
        single = gzip.GzipFile(fileobj=io.BytesIO(blob)) if blob[:2] == b"\x1f\x8b" else io.BytesIO(blob)
        yield "main.tex", _bounded(single, MOST_OF_ONE)
        return
    with tar:
        for e in tar:
            if e.issym() or e.islnk():
                raise Refused("link")
            if e.isfile():
                yield e.name, _bounded(tar.extractfile(e), MOST_OF_ONE)


def members(blob: bytes) -> tuple[list[tuple[str, bytes]], str | None]:
    """SC2: (files, None), or ([], why an archive is refused): links, unsafe names, too many or too large files."""
    out, total = [], 0
    try:
        if blob[:5] == b"%PDF-":
            raise Refused("pdf")
        for name, content in _entries(blob):
            if not safe(name):
                raise Refused("unsafe_path")
            parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
            if any(p.startswith(".") or p == "__MACOSX" for p in parts):
                continue
            out.append(("/".join(parts), content))
            total += len(content)
            if len(out) > MOST_FILES or total > MOST_BYTES:
                raise Refused("too_large")
    except Refused as e:
        return [], str(e)
    except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, RuntimeError, NotImplementedError):
        return [], "damaged"
    return out, None


def expand(blobs: DataFrame) -> DataFrame:
    """SC2, SC3: (project, path, text, size, error) from (path, content) of the binaryFile source.

    A refused archive gives one row with its error. An archive is at most 300 MB unpacked, read in one task.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for project, content in frame.itertuples(index=False, name=None):
                files, error = members(content or b"")
                rows = [(project, p, decode(b), len(b), None) for p, b in files] or [(project, None, None, None, error)]
                yield pd.DataFrame(rows, columns=["project", "path", "text", "size", "error"])

    return blobs.select("path", "content").mapInPandas(each, "project string, path string, text string, size long, error string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return expand(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def job_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC1: jobs of */job.json; damaged files are left out."""
    rows = spark.read.schema(schema + ", _damaged string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged").option("multiLine", "true").json(path + "/*/job.json")
    return rows.where("_damaged is null and id is not null").drop("_damaged")


def batch_list(spark: SparkSession, path: str) -> DataFrame:
    """SC9: (list, source) without blank lines and comments; relative names are below the list's folder."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("list"), F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    local = F.col("v").rlike(r"^\.{1,2}/|\.(?:tex|zip|tar|gz|tgz)$") & ~F.col("v").rlike(r"^(?:/|[A-Za-z][A-Za-z0-9+.-]*://)")
    return rows.select("list", F.when(local, F.concat(F.regexp_replace("list", r"[^/]*$", ""), F.col("v"))).otherwise(F.col("v")).alias("source"))


def rule_inputs(text: str) -> list[str]:
    r"""SC10: the inputs of a make rule; backslashes keep blanks and join lines."""
    _, _, names = re.sub(r"\\\r?\n", " ", text).partition(":")
    return [re.sub(r"\\(.)", r"\1", n).replace("$$", "$") for n in re.findall(r"(?:\\.|[^\s\\])+", names)]


def recorded_inputs(lines: DataFrame) -> DataFrame:
    """SC10: the distinct inputs of a recorder's lines (value)."""
    return lines.where(F.col("value").startswith("INPUT ")).select(F.trim(F.substring("value", 7, 1 << 20)).alias("path")).distinct()


def control_inputs(text: str) -> list[str] | None:
    """SC11: data sources of a bibliography control file; None with entities or damage."""
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.I):
        return None
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None
    return [(e.text or "").strip() for e in root.iter() if e.tag.rpartition("}")[2] == "datasource" and (e.text or "").strip()]


def main_rank(path: Column, body: Column, size: Column) -> Column:
    """RK3: the order in which files are taken as a project's main one, the smallest first: Latin script, a usual name, depth, size."""
    letters, latin = F.regexp_count(body, F.lit(r"\p{L}")), F.regexp_count(body, F.lit("[A-Za-z]"))
    usual = F.element_at(F.split(path, "/"), -1).isin("main.tex", "paper.tex", "ms.tex")
    return F.struct(((letters > 0) & (latin < letters / 2)).alias("c"), (~usual).alias("n"), F.size(F.split(path, "/")).alias("d"), (-size).alias("s"), path.alias("p"))


def main_files(files: DataFrame) -> DataFrame:
    """RK3: (project, main) from (project, path, text, size), of files with a class of their own and a document; null texts are none."""
    body = F.regexp_extract("text", r"(?ms)^[^%\n]*?\\begin\s*\{document\}(.*)", 1)
    whole = F.col("text").rlike(r"(?m)^[^%\n]*\\document(?:class|style)\b") & F.col("text").rlike(r"(?m)^[^%\n]*\\begin\s*\{document\}")
    tex = files.where(F.col("path").endswith(".tex") & whole)
    return tex.groupBy("project").agg(F.min_by("path", main_rank(F.col("path"), body, F.col("size"))).alias("main"))
