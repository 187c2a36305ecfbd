"""Files as tables: listings, text with rejects, JSON lines, flattened configuration, git history."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed limits of a text file.
MAX_BYTES, BINARY_PROBE = 16 << 20, 8000
SKIPPED = ("build", "dist", "venv", ".venv", "node_modules", "__pycache__", ".git", ".tox", ".mypy_cache")


def list_files(spark: SparkSession, root: str, pattern: str = "*", exclude: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path (relative), n_bytes, content of the files below ``root`` by name pattern; excluded folders fall out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace("path", rf"^.*?\Q{base}\E/", "")
    skip = rf"(^|/)({'|'.join(x.replace('.', r'[.]') for x in exclude)})/"
    return raw.select(rel.alias("path"), F.col("length").alias("n_bytes"), "content").where(~F.col("path").rlike(skip))


def decoded(files: DataFrame) -> DataFrame:
    """Adds text and error. A byte order mark goes; other encodings than UTF-8 only by a coding line; binary and too large files are errors; no byte is replaced."""

    def one(content: bytes) -> tuple[str | None, str | None]:
        import io
        import tokenize

        if len(content) > MAX_BYTES:
            return None, "too large"
        if b"\0" in content[:BINARY_PROBE]:
            return None, "binary"
        try:
            encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
            return content.decode(encoding), None
        except (SyntaxError, UnicodeError, LookupError) as e:
            return None, f"{type(e).__name__}: {e}"[:300]

    @F.pandas_udf("text string, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(bytes(x)) for x in b], columns=["text", "error"])

    out = files.withColumn("_r", read("content"))
    return out.select(*[c for c in files.columns if c != "content"], F.col("_r.text").alias("text"), F.col("_r.error").alias("error"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (plain or gzip); rows that don't fit the schema keep their text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def _flat(value: object, at: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _flat(v, f"{at}[{i}]")
    else:
        yield at, json.dumps(value, ensure_ascii=False, default=str)


def parse_config(path: str, text: str) -> list[tuple[str, str]]:
    """(entry, JSON value) of a TOML, JSON, INI or .env file, by suffix; repeated JSON keys are errors."""
    name = path.rsplit("/", 1)[-1]
    if name.endswith(".toml"):
        import tomllib

        return list(_flat(tomllib.loads(text)))
    if name.endswith((".json", ".arb")):

        def once(pairs: list[tuple[str, object]]) -> dict:
            d = dict(pairs)
            if len(d) < len(pairs):
                raise ValueError("repeated key")
            return d

        return list(_flat(json.loads(text, object_pairs_hook=once)))
    if name.endswith((".ini", ".cfg")):
        import configparser

        c = configparser.ConfigParser(interpolation=None)
        c.read_string(text)
        return [(f"{s}.{k}", json.dumps(v)) for s in c.sections() for k, v in c[s].items()]
    if name.startswith(".env"):
        rows = [x.split("=", 1) for x in text.splitlines() if "=" in x and not x.lstrip().startswith("#")]
        return [(k.strip().removeprefix("export "), json.dumps(v.strip().strip("'\""))) for k, v in rows]
    raise ValueError(f"no parser for {name}")


def config_entries(files: DataFrame) -> DataFrame:
    """(path, text) -> path, entry, value (JSON), error: one row an entry, or one row with an error."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, text in zip(f["path"], f["text"], strict=True):
                try:
                    out += [(path, k, v, None) for k, v in parse_config(path, text)]
                except Exception as e:  # every file that can't be read is a row, not a failed job
                    out.append((path, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["path", "entry", "value", "error"])

    return files.select("path", "text").mapInPandas(rows, "path string, entry string, value string, error string")


def git_history(spark: SparkSession, repo: str, path: str | None = None, timeout: int = 120) -> DataFrame:
    """First-parent history, newest last: seq, sha, parent, ts, subject, trailers. Read by git on the driver; a failing git is an error."""
    form = "%H%x1f%P%x1f%cI%x1f%s%x1f%(trailers:only,unfold,separator=%x1e)%x1d"
    cmd = ["git", "-C", repo, "log", "--first-parent", "--reverse", f"--format={form}", *(["--", path] if path else [])]
    said = subprocess.run(cmd, capture_output=True, text=True, timeout=timeout, check=True).stdout
    rows = []
    for seq, x in enumerate(x for x in said.split("\x1d") if x.strip()):
        sha, parents, ts, subject, trailers = x.strip("\n").split("\x1f")
        pairs = dict(t.split(": ", 1) for t in trailers.split("\x1e") if ": " in t)
        rows.append((seq, sha, parents.split(" ")[0] or None, ts, subject, pairs))
    out = spark.createDataFrame(rows, "seq int, sha string, parent string, ts string, subject string, trailers map<string,string>")
    return out.withColumn("ts", F.to_timestamp("ts"))
