"""What a file holds, by its first bytes rather than by its name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Leading bytes of formats.
SIGNATURES = {
    b"\x93NUMPY": "npy",
    b"PAR1": "parquet",
    b"\x89HDF\r\n\x1a\n": "hdf5",
    b"PK\x03\x04": "zip",
    b"II*\x00": "tiff",
    b"MM\x00*": "tiff",
    b"MATLAB 5.0": "mat",
    b"\x1f\x8b": "gzip",
}


def sniff(head: bytes) -> str | None:
    """Format of leading bytes: a signature, else json or csv for plausible text."""
    for signature, name in SIGNATURES.items():
        if head.startswith(signature):
            return name
    try:
        text = head.decode("utf-8", errors="strict")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:  # a cut character at the end is no objection
            return None
        text = head[: e.start].decode("utf-8")
    if not text.strip() or sum(ord(c) < 32 and c not in "\t\r\n" for c in text) > 0.02 * len(text):
        return None
    if text.lstrip()[:1] in "[{":
        return "json"
    return "csv" if any(s in text.splitlines()[0] for s in ",;\t") else "text"


def resolve(spark: SparkSession, path: str, head: int = 4096) -> tuple[str | None, str]:
    """(format, note): content wins over the extension; the note says where they differ."""
    rows = spark.read.format("binaryFile").load(path).orderBy("path").select("path", F.substring("content", 1, head).alias("head")).limit(1).collect()
    if not rows:
        raise FileNotFoundError(path)
    found = sniff(bytes(rows[0]["head"]))
    named = rows[0]["path"].rsplit(".", 1)[-1].lower()
    named = {"txt": "csv", "tsv": "csv", "tif": "tiff", "h5": "hdf5", "jsonl": "json"}.get(named, named)
    if found is None:
        return named, "content not recognized; the extension was used"
    return found, "" if found == named else f"named {named}, but it holds {found}"
