"""Release archives: npm tarballs, Python source releases and wheels, unpacked in memory, one at a time.

Spark's file listing leaves out names that start with `_` or `.` and empty files, so whole releases are read this way;
`evidence.source_files` is for trees without such names.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members and bytes that an archive may hold.
MEMBERS, BYTES = 50_000, 500 * 1024 * 1024
FILES = "ecosystem string, package string, version string, label string, path string, name string, size_bytes long, text string, error string"


class Refused(Exception):
    """The archive breaks a rule and is not unpacked at all."""


def _safe(name: str) -> str:
    clean = "/".join(p for p in name.replace("\\", "/").split("/") if p not in ("", "."))
    if name.startswith(("/", "\\")) or ".." in clean.split("/") or re.match(r"[A-Za-z]:", name):
        raise Refused(f"a member leaves the archive: {name[:80]}")
    return clean


def members(content: bytes, label: str) -> list[tuple[str, bytes]]:
    """(path, bytes) of the files of an archive, below its one top folder where the kind of archive has one."""
    out, total = [], 0
    try:
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                infos = z.infolist()
                if len(infos) > MEMBERS or sum(i.file_size for i in infos) > BYTES:
                    raise Refused("the archive is too large")
                for i in infos:
                    path = _safe(i.filename)
                    if i.external_attr >> 28 == 0xA:
                        raise Refused("the archive holds a link")
                    if not i.is_dir():
                        out.append((path, z.read(i)))
        else:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                for n, i in enumerate(t):
                    total += i.size
                    if n >= MEMBERS or total > BYTES:
                        raise Refused("the archive is too large")
                    path = _safe(i.name)
                    if i.isfile():
                        out.append((path, t.extractfile(i).read()))
    except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError, NotImplementedError, RuntimeError) as e:
        raise Refused(f"not readable: {type(e).__name__}") from None
    tops = {p.split("/", 1)[0] for p, _ in out}
    if label == "package" and "package" not in tops:
        raise Refused("no folder named package")
    if label == "package":
        return [(p.split("/", 1)[1], b) for p, b in out if p.startswith("package/")]
    if label == "sdist" and len(tops) == 1 and all("/" in p for p, _ in out):
        return [(p.split("/", 1)[1], b) for p, b in out]
    return out


def _run(frames):
    import pandas as pd

    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            key = (r.ecosystem, r.package, r.version, r.label)
            try:
                rows += [(*key, p, p.rsplit("/", 1)[-1], len(b), b.decode("utf-8", "replace"), None) for p, b in members(bytes(r.content), r.label)]
            except Refused as e:
                rows.append((*key, None, None, None, None, str(e)))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in FILES.split(", ")])
        out["size_bytes"] = out["size_bytes"].astype("Int64")
        yield out


def unpack(archives: DataFrame) -> DataFrame:
    """Files of archives (ecosystem, package, version, label, content), and one row with `error` for each that is refused."""
    return archives.select("ecosystem", "package", "version", "label", "content").mapInPandas(_run, FILES)


def source_files(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, errors by release)."""
    every = unpack(archives)
    return every.where("error is null").drop("error"), every.where("error is not null").select("ecosystem", "package", "version", F.col("error").alias("scan_error")).distinct()
