"""Archives of several formats out of files, directories and other archives, whose members become entries."""

from __future__ import annotations

import importlib.util
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans import store
from cairn.sources import archive, files

# Formats and the suffixes that containers lose.
FORMATS = ("qbx", "zip", "7z", "rar")


def format_of(name: str) -> str:
    """The format's name without dot, in lower case."""
    fmt = name.lower().lstrip(".")
    if fmt not in FORMATS:
        raise archive.ArchiveError(f"unsupported output format: {name}")
    return fmt


def capabilities(spark: SparkSession) -> DataFrame:
    """Which formats can be written here: 7z needs its library, RAR an external program."""
    have = {"qbx": True, "zip": True, "7z": importlib.util.find_spec("py7zr") is not None, "rar": (shutil.which("rar") or shutil.which("WinRAR")) is not None}
    return spark.createDataFrame(list(have.items()), "format string, available boolean")


def container_of(path: str) -> str | None:
    """Native by suffix, ZIP by its content, 7z and RAR by suffix."""
    import zipfile

    low = path.lower()
    if low.endswith(".qbx"):
        return "qbx"
    if zipfile.is_zipfile(path):
        return "zip"
    return next((k for k in ("7z", "rar") if low.endswith(f".{k}")), None)


def _opened(spark: SparkSession, source: str, kind: str, prefix: str, sizes: files.Sizes) -> tuple[DataFrame, list[str]]:
    """Chunk table and directories of a container's members."""
    if kind == "zip":
        return files.zip_chunks(spark, source, sizes=sizes, prefix=prefix)
    if kind == "qbx":
        table, directories = store.chunk_table(spark, source)
        return table.withColumn("path", F.concat(F.lit(prefix), "path")), [prefix + d for d in directories]
    if kind == "7z" and importlib.util.find_spec("py7zr"):
        import py7zr

        folder = tempfile.mkdtemp(prefix="cairn-7z-", dir=str(Path(source).resolve().parent))
        try:
            with py7zr.SevenZipFile(source) as z:
                if bad := next((n for n in z.getnames() if not archive.safe(n.replace("\\", "/"))), None):
                    raise archive.ArchiveError(f"unsafe member: {bad}")
                z.extractall(folder)
            table, directories = files.chunks(spark, folder, sizes=sizes, prefix=prefix)
            return store.staged(table, "members"), directories
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    raise archive.ArchiveError(f"containers of this kind can't be read here: {kind}")


def union_root(spark: SparkSession, sources: list[str], *, optimize: bool = True, sizes: files.Sizes = files.DEFAULT) -> tuple[DataFrame, list[str], dict]:
    """One chunk table of all sources, its directories, and what was opened.

    One directory becomes the root as it is, and so does one container. Of several sources, containers stand under their name without
    suffix and others under their own; of equal paths the later one counts, but a native archive may not cover an earlier entry.
    """
    if not sources:
        raise archive.ArchiveError("no sources")
    if missing := next((s for s in sources if not Path(s).exists()), None):
        raise archive.ArchiveError(f"no such source: {missing}")
    one, tables, directories, kinds, taken = len(sources) == 1, [], [], [], set()
    for source in sources:
        name, is_dir = Path(source).name, Path(source).is_dir()
        kind = container_of(source) if optimize and not is_dir else None
        if kind:
            stem = name[: -len(kind) - 1] if name.lower().endswith(f".{kind}") else name
            prefix = "" if one else f"{stem or 'archive'}/"
            table, more = _opened(spark, source, kind, prefix, sizes)
            kinds.append(kind)
            if kind == "qbx" and not one:
                paths = {prefix + f["path"] for f in archive.read_manifest(source)[1]["files"]}
                if clash := next(iter(sorted(paths & taken)), None):
                    raise archive.ArchiveError(f"exists already: {clash}")
                taken |= paths
            elif kind == "zip":
                taken |= {prefix + p for p in files.zip_listing(source)[0]}
        else:
            prefix = f"{name}/" if is_dir and not one else ""
            table, more = files.chunks(spark, source, sizes=sizes, prefix=prefix)
            taken |= {prefix + p for _, p, *_ in files.walk(source)[0]}
        tables.append(table)
        directories += more
    table = tables[0] if len(tables) == 1 else store.merged(tables)
    return table, directories, {"optimized_source_archives": len(kinds), "source_containers": kinds, "logical_transform": bool(kinds)}


def create_archive(spark: SparkSession, sources: list[str], output: str, *, output_format: str, optimize: bool = True, sizes: files.Sizes = files.DEFAULT, **options: object) -> dict:
    """Write all sources as one archive; the output gets the suffix of its format, and an existing one is replaced."""
    fmt = format_of(output_format)
    path = Path(output).resolve()
    path.parent.mkdir(parents=True, exist_ok=True)
    path = path if path.suffix.lower() == f".{fmt}" else path.with_suffix(f".{fmt}")
    table, directories, told = union_root(spark, sources, optimize=optimize, sizes=sizes)
    if fmt == "qbx":
        return store.write(table, directories, str(path), sizes=sizes, **options) | told | {"output_format": fmt, "output": str(path)}
    if fmt == "zip":
        files.write_zip(table, directories, str(path))
    elif fmt == "7z" and importlib.util.find_spec("py7zr"):
        _write_7z(table, directories, path)
    else:
        raise archive.ArchiveError(f"archives of this format can't be written here: {fmt}")
    return {"ok": True, "output_format": fmt, "output": str(path), "archive": path.stat().st_size, "qbx_resilience_embedded": False} | told


def _write_7z(table: DataFrame, directories: list[str], path: Path) -> None:
    """Through a folder beside the output, since the library reads files."""
    import py7zr

    folder = Path(tempfile.mkdtemp(prefix="cairn-7z-", dir=str(path.parent)))
    try:
        for d in directories:
            (folder / d).mkdir(parents=True, exist_ok=True)
        for r in table.orderBy("path", "seq").select("path", "raw").toLocalIterator():
            (folder / r.path).parent.mkdir(parents=True, exist_ok=True)
            with (folder / r.path).open("ab") as f:
                f.write(bytes(r.raw or b""))
        with py7zr.SevenZipFile(path, "w") as z:
            for p in sorted(folder.iterdir()):
                z.writeall(p, p.name)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
