"""Reading by suffix, arrays, small documents, and sinks that check what they write."""

from __future__ import annotations

import io
import json
import zlib
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sondeflow.sources.staging import staged


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """CSV (with a header), JSON lines or Parquet by suffix; columns are pruned at the scan.

    schema (DDL) gives a CSV's types by column name in whatever order the file has them, so that no pass infers them; what it doesn't name is text.
    """
    suffix = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if suffix == "csv" and schema:
        kinds = {f.name: f.dataType for f in StructType.fromDDL(schema)}
        df = spark.read.option("header", True).csv(path)
        df = df.select(*(F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns))
    elif suffix == "csv":
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    elif suffix in ("json", "jsonl"):
        df = spark.read.json(path)
    elif suffix == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for .{suffix}")
    return df.select(*columns) if columns else df


def read_all(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Several tables by name, each also a temporary view."""
    out = {n: read_table(spark, p) for n, p in paths.items()}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """NPY and NPZ files: path, name (empty for NPY), place, value, a row for each number of the flattened arrays. Pickled objects are refused."""

    def run(batches):
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"]):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                for name, a in {k: got[k] for k in got.files}.items() if hasattr(got, "files") else [("", got)]:
                    flat = np.asarray(a, float).ravel()
                    yield pd.DataFrame({"path": path_, "name": name, "place": np.arange(len(flat)), "value": flat})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, place long, value double")


def read_settings(spark: SparkSession, path: str) -> dict:
    """A small JSON (or, where PyYAML is installed, YAML) document as a dictionary, read through Spark so that any store works."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("reading YAML needs PyYAML") from e
        return yaml.safe_load(text)
    return json.loads(text)


#: Groups that the facts list themselves; the table of counts has all.
MOST_LISTED = 10_000


def write_with_facts(df: DataFrame, path: str, keys: list[str]) -> dict:
    """Write Parquet and return rows, columns, groups, counts by keys and the time; the facts also go to {path}.meta.json, as one JSON line.

    The counts of all groups go to {path}.counts, as Parquet. `by` lists them all too, or is None where there are over MOST_LISTED."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    back.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(f"{path}.counts")
    counts = df.sparkSession.read.parquet(f"{path}.counts")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    by = [r.asDict() for r in counts.collect()] if total["groups"] <= MOST_LISTED else None
    facts = {"rows": total["rows"], "columns": back.columns, "groups": total["groups"], "by": by, "counts": f"{path}.counts", "written": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    df.sparkSession.createDataFrame([(json.dumps(facts, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta.json")
    return facts


def submission(sample: DataFrame, predictions: DataFrame, id_: str, value: str, fallback: float | None = None) -> DataFrame:
    """Every id of the sample with its prediction, or the fallback; an id without either raises."""
    ids = sample.select(id_)
    out = staged(ids.join(predictions.select(id_, F.col(value).alias("tvt")), id_, "left").withColumn("tvt", F.coalesce("tvt", F.lit(fallback).cast("double"))))
    faults = out.agg(F.count_if(F.col("tvt").isNull()).alias("missing"), (F.count("*") - F.countDistinct(id_)).alias("repeated")).first()
    if faults["missing"] or faults["repeated"]:
        raise ValueError(f"{faults['missing']} ids without a prediction, {faults['repeated']} repeated")
    return out


def content_hash(df: DataFrame, columns: list[str]) -> str:
    """SHA-256 over the rows' own hashes in sorted order of a few bits, the same for the same rows in any order: sums of 52-bit parts of each row's SHA-256."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 13 * k, 13), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    row = df.agg(F.count("*").alias("n"), *parts).first()
    import hashlib

    return hashlib.sha256(":".join(str(x) for x in row).encode()).hexdigest()


def as_markdown(df: DataFrame, rows: int = 50) -> str:
    """A small report as a Markdown table: at most `rows` rows."""
    got = df.limit(rows).collect()
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in got])


def first_root(spark: SparkSession, roots: list[str], needed: list[str]) -> str:
    """The first of several folders that holds all needed files or folders."""
    from sondeflow.operators.validation import present_files

    for root in roots:
        if all(present_files(spark, [f"{root.rstrip('/')}/{n}" for n in needed]).values()):
            return root
    raise FileNotFoundError(f"none of {roots} holds {needed}")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one_file for small results that a person opens."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_settings(spark: SparkSession, payload: dict, path: str) -> None:
    """A small dictionary as one JSON document, written through Spark so that any store works."""
    spark.createDataFrame([(json.dumps(payload, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def resumed(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at the path if a run finished writing it, else what make() gives, written there: a job that starts again goes on behind it."""
    from sondeflow.operators.validation import present_files

    if not present_files(spark, [f"{path}/_SUCCESS"])[f"{path}/_SUCCESS"]:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def filled_submission(sample: DataFrame, base: DataFrame, delta: DataFrame, id_: str, anchor: str, value: str, constant: float) -> DataFrame:
    """Every id of the sample with anchor + delta, the anchor where the delta is missing, and the constant where both are: no id is left without a value."""
    rows = base.select(id_, anchor).join(delta.select(id_, F.col(value).alias("__d")), id_, "left")
    guess = F.col(anchor) + F.coalesce("__d", F.lit(0.0))
    return sample.select(id_).join(rows.select(id_, guess.alias("tvt")), id_, "left").withColumn("tvt", F.coalesce("tvt", F.lit(float(constant))))


def read_contours(spark: SparkSession, path: str, colour: tuple[int, int, int], tolerance: int = 40) -> DataFrame:
    """path, column, row of the pixels whose colour lies within the tolerance of one, from PNG or binary PPM (P6) images: the mean row of each column that has any."""

    def run(batches):
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"]):
                pixels = _png(content) if content[:8] == PNG else _ppm(content)
                hit = (np.abs(pixels.astype(int) - np.array(colour)) <= tolerance).all(axis=2)
                columns = np.flatnonzero(hit.any(axis=0))
                rows = (hit * np.arange(len(hit))[:, None]).sum(axis=0)[columns] / hit.sum(axis=0)[columns]
                yield pd.DataFrame({"path": path_, "column": columns, "row": rows.astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, column long, row double")


#: First bytes of a PNG file (fixed value).
PNG = b"\x89PNG\r\n\x1a\n"


def _png(content: bytes) -> np.ndarray:
    """Rows, columns, colours of a PNG image of one byte a sample, not interlaced: grey, colours or a palette, an alpha channel is left out."""
    at, told, palette, packed = 8, None, None, []
    while at < len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(content[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"damaged PNG: {kind!r}")
        if kind == b"IHDR":
            told = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if told is None or told[8] != 8 or told[12]:
        raise ValueError("a PNG of one byte a sample that is not interlaced is asked for")
    width, height, colour = int.from_bytes(told[:4], "big"), int.from_bytes(told[4:8], "big"), told[9]
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * samples)
    out = np.zeros((height, width, samples), np.uint8)
    above = np.zeros((width, samples), np.uint8)
    for k, line in enumerate(lines):
        above = out[k] = _unfiltered(int(line[0]), line[1:].reshape(width, samples), above)
    if colour == 3:
        return palette[out[:, :, 0]]
    return out[:, :, :3] if colour in (2, 6) else np.repeat(out[:, :, :1], 3, axis=2)


def _unfiltered(way: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A line of pixels from what is stored of it: itself, or its difference to the left, the upper, their mean, or the nearest of left, upper and upper left to their sum less the last."""
    if way == 0:
        return line
    if way == 1:
        return np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
    if way == 2:
        return line + above
    out = np.zeros(line.shape, np.int64)
    left = corner = np.zeros(line.shape[1], np.int64)
    for x, (stored, up) in enumerate(zip(line.astype(np.int64), above.astype(np.int64))):
        if way == 3:
            guess = (left + up) // 2
        else:
            far = np.stack((np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)))
            guess = np.choose(far.argmin(axis=0), (left, up, corner))
        left, corner = (stored + guess) & 255, up
        out[x] = left
    return out.astype(np.uint8)


def _ppm(content: bytes) -> np.ndarray:
    """Rows, columns, colours of a P6 image of one byte a colour."""
    words, at = [], 0
    while len(words) < 4:
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        if content[at : at + 1] == b"#":
            end = content.index(b"\n", at)
        elif end > at:
            words.append(content[at:end])
        at = end + 1
    if words[0] != b"P6" or int(words[3]) > 255:
        raise ValueError("not a P6 image of one byte a colour")
    width, height = int(words[1]), int(words[2])
    return np.frombuffer(content, np.uint8, width * height * 3, at).reshape(height, width, 3)
