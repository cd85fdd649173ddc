"""Readers of raw archives, JSON lines, CSV and TOML."""

from __future__ import annotations

import hashlib
import json
import tomllib
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.schema import ANNOTATION, GOLD, MANIFEST, MATCH_QUERY, RAW

CHUNK = 1 << 20


def sha256_file(path: str | Path) -> str:
    """SHA-256 of a file, read in chunks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(CHUNK):
            h.update(block)
    return h.hexdigest()


def _items(stream, size: int = CHUNK):
    """The items of a top-level JSON array, decoded one by one from a text stream.

    A place in the buffer moves on; what is behind it leaves with the next block. Where an item goes beyond the buffer, as
    much again is read before it is tried again, so a long item is decoded a few times at most.
    """
    decoder, text, at, more, ended = json.JSONDecoder(), "", 0, size, False

    def fill() -> None:
        nonlocal text, at, ended
        got = []
        while not ended and sum(map(len, got)) < more:
            block = stream.read(more)
            ended = not block
            got.append(block)
        text, at = text[at:] + "".join(got), 0

    def skip(signs: str) -> str:
        """The first character that is none of the signs, empty at the end."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in signs:
                at += 1
            if at < len(text) or ended:
                return text[at : at + 1]
            fill()

    if skip(" \t\r\n") != "[":
        raise ValueError("the archive's JSON is not an array")
    at += 1
    while True:
        sign = skip(" \t\r\n,")
        if sign == "]":
            return
        if not sign:
            raise ValueError("the archive's JSON array does not end")
        try:
            item, end = decoder.raw_decode(text, at)
            if text[end : end + 1] not in tuple(" \t\r\n,]"):
                raise ValueError("an item of the array does not end")  # or a number goes on in the next block
        except ValueError:
            if ended:
                raise
            more = max(size, len(text) - at)
            fill()
            continue
        at, more = end, size
        yield item


def archive_to_lines(archive: str | Path, out: str | Path) -> int:
    """Convert a JSON array, plain or as the only .json member of a ZIP, to JSON lines once, so that the scan can be split.

    Lines carry their place in `_pos`; items that are no objects become `{"_invalid": true}` so that they are counted.
    """
    archive, n = Path(archive), 0
    with open(out, "w", encoding="utf-8") as f:
        if zipfile.is_zipfile(archive):
            with zipfile.ZipFile(archive) as z:
                members = [m for m in z.namelist() if m.lower().endswith(".json")]
                if len(members) != 1:
                    raise ValueError(f"the archive holds {len(members)} JSON files, not one")
                import io

                with z.open(members[0]) as raw:
                    n = _write_lines(io.TextIOWrapper(raw, encoding="utf-8"), f)
        else:
            with open(archive, encoding="utf-8") as raw:
                n = _write_lines(raw, f)
    return n


def _write_lines(stream, out) -> int:
    n = 0
    for n, item in enumerate(_items(stream), 1):
        row = dict(item) if isinstance(item, dict) else {"_invalid": True}
        for k, v in row.items():
            if v is not None and not isinstance(v, (str, bool)):
                row[k] = json.dumps(v, ensure_ascii=False)
        out.write(json.dumps(row | {"_pos": n}, ensure_ascii=False) + "\n")
    return n


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of JSON lines: the accepted fields, `_pos` and `_invalid`; unknown fields are dropped."""
    schema = T.StructType([*RAW.fields, T.StructField("_pos", T.LongType()), T.StructField("_invalid", T.BooleanType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("_invalid", F.coalesce("_invalid", F.lit(False)))


def read_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON-lines table: gold, annotation, manifest or match_query. Blank lines are skipped."""
    schema = {"gold": GOLD, "annotation": ANNOTATION, "manifest": MANIFEST, "match_query": MATCH_QUERY}[kind]
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_annotation_csv(spark: SparkSession, path: str) -> DataFrame:
    """``job_id, skill, label`` with a header."""
    return spark.read.schema("job_id string, skill string, label string").option("header", True).option("enforceSchema", False).csv(path)


def read_toml(path: str | Path) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))
