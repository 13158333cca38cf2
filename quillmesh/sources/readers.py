"""Readers: tables, packed CSV, JSON lines with rejects, pool documents, line lists and run histories.

Every path goes through Spark's own file systems, so any store that the cluster
can read will do.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.numeric import label_of
from quillmesh.functions.text import norm_lower, squeeze


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with header and quoted fields; without a schema every column is text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def normalise_table(df: DataFrame) -> DataFrame:
    """Lower-cased, trimmed headers, trimmed text, no rows of nulls alone."""
    named = df.toDF(*[c.strip().lower() for c in df.columns])
    trimmed = named.select(*[F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in named.schema])
    return trimmed.dropna("all")


def read_packed_csv(spark: SparkSession, path: str, member: str, columns: Sequence[str]) -> DataFrame:
    """CSV text inside ZIP or gzip files, or plain, told apart by their first bytes.

    ``member`` names the file in a ZIP: the same path, else any path that ends
    in its file name, without regard to case. Columns that a file lacks are null.
    """
    tail = member.rsplit("/", 1)[-1].lower()

    def unpack(raw: bytes) -> bytes:
        import gzip
        import io
        import zipfile

        if raw[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                names = z.namelist()
                found = [n for n in names if n == member] or [n for n in names if n.lower().rsplit("/", 1)[-1] == tail]
                if not found:
                    raise FileNotFoundError(f"no {member} among {names[:5]}")
                return z.read(found[0])
        return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for raw in batch["content"]:
                chunks = pd.read_csv(io.BytesIO(unpack(raw)), dtype=str, skipinitialspace=True, skip_blank_lines=True, chunksize=5000)
                for part in chunks:
                    part.columns = [c.strip().lower() for c in part.columns]
                    part = part.reindex(columns=list(columns)).apply(lambda s: s.str.strip()).dropna(how="all")
                    yield part.astype(object).where(part.notna(), None)

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def first_of(attempts: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read; the last error if none can.

    Reading is lazy, so a row of each source is asked for before it is taken.
    """
    error: Exception | None = None
    for attempt in attempts:
        try:
            found = attempt()
            found.take(1)
            return found
        except Exception as e:  # a tier that fails gives way to the next
            error = e
    raise error or ValueError("no source given")


def existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists in its store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(f"none of {list(paths)}")


def pick_column(df: DataFrame, preferred: str | None, candidates: Sequence[str]) -> str:
    """The preferred column if present, else the first candidate that is."""
    for c in ([preferred] if preferred else []) + list(candidates):
        if c in df.columns:
            return c
    raise KeyError(f"none of {list(candidates)} in {df.columns}")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df


def canonical_corpus(df: DataFrame, dataset: str, lang: str, flip: bool = False) -> DataFrame:
    """(dataset, lang, text, label) of a raw corpus with any of the usual headers; rows without a known label go."""
    text, label = pick_column(df, None, ("text", "article", "content")), pick_column(df, None, ("label", "labels", "target"))
    out = df.select(F.lit(dataset).alias("dataset"), F.lit(lang).alias("lang"), squeeze(F.col(text)).alias("text"), label_of(F.col(label), flip=flip).alias("label"))
    return out.filter(F.col("label").isNotNull() & (F.length("text") > 10))


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    """A hold-out CSV with true_label as 0, 1 or null in ``label``; other columns stay."""
    df = read_csv(spark, path)
    return df.withColumn("label", label_of(F.lower(F.trim(F.col("true_label")))))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON lines; blank lines are skipped.

    ``reject`` routes malformed lines to rejects(line, reason), ``skip`` drops
    them, ``fail`` stops at the first.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "FAILFAST" if mode == "fail" else "PERMISSIVE"}
    parsed = lines.select("value", F.from_json("value", kind if mode == "fail" else marked, options).alias("r"))
    if mode == "fail":
        return parsed.select("r.*"), parsed.sparkSession.createDataFrame([], "line string, reason string")
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    good = parsed.filter(~bad).select(*[F.col("r")[f.name].alias(f.name) for f in kind.fields])
    rejects = parsed.filter(bad).select(F.col("value").alias("line"), F.lit("malformed_json").alias("reason"))
    return good, rejects if mode == "reject" else rejects.limit(0)


def read_pool(spark: SparkSession, path: str, card: T.StructType | str) -> DataFrame:
    """The cards of pool documents: a JSON array, or an object with ``cards`` (and ``_metadata``, kept as text)."""
    kind = card if isinstance(card, str) else card.simpleString()
    raw = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", f"struct<_metadata:string,cards:array<{kind}>>")
    bare = F.from_json("value", f"array<{kind}>")
    array = F.startswith(F.ltrim("value"), F.lit("["))
    both = raw.select(F.when(array, F.lit(None)).otherwise(doc["_metadata"]).alias("pool_metadata"), F.explode(F.when(array, bare).otherwise(doc["cards"])).alias("card"))
    return both.select("pool_metadata", "card.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines that are not blank."""
    return spark.read.text(path).filter(F.trim("value") != "")


def read_terms(spark: SparkSession, path: str, extra: Sequence[str] = (), inline_comments: bool = True) -> list[str]:
    """A term list: comments and blanks skipped, lower-cased, distinct, longest first. Lists are small parameter files."""
    line = F.trim(F.regexp_replace("value", "#.*$" if inline_comments else "^#.*$", ""))
    rows = spark.read.text(path).select(F.lower(line).alias("term")).filter("term <> ''").distinct().collect()
    return sorted({r.term for r in rows} | {e.lower() for e in extra}, key=lambda t: (-len(t), t))


def allowed_terms(profiles: DataFrame, fields: Sequence[str] = ("display_name", "public_name", "short_name"), aliases: str | None = "aliases", always: Sequence[str] = ("candidate a", "candidate b", "candidate c")) -> DataFrame:
    """(term): the distinct normalised names and aliases of candidate profiles, and those always allowed."""
    own = F.array(*[F.col(c).cast("string") for c in fields if c in profiles.columns])
    more = F.coalesce(F.col(aliases), F.array().cast("array<string>")) if aliases and aliases in profiles.columns else F.array().cast("array<string>")
    named = profiles.select(F.explode(F.concat(own, more)).alias("t")).select(norm_lower(F.col("t")).alias("term")).filter("term <> ''")
    fixed = profiles.sparkSession.createDataFrame([(a,) for a in always], "term string")
    return named.unionByName(fixed).distinct()


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(step, epoch, loss, eval_loss, eval_f1) of trainer states, one row a log entry."""
    entry = "struct<step:bigint,epoch:double,loss:double,eval_loss:double,eval_f1:double>"
    raw = spark.read.text(path, wholetext=True)
    logs = raw.select(F.explode(F.from_json("value", f"struct<log_history:array<{entry}>>")["log_history"]).alias("e"))
    return logs.select("e.*").filter("loss IS NOT NULL OR eval_loss IS NOT NULL OR eval_f1 IS NOT NULL")


def checkpoint_step(path: Column) -> Column:
    """The number that a checkpoint's name ends in."""
    return F.regexp_extract(path, r"-(\d+)/?$", 1).try_cast("bigint")


def config(defaults: dict[str, Any], env: dict[str, str] | None = None, prefix: str = "QM_") -> dict[str, Any]:
    """Defaults overridden by environment variables, read as the default's type; a bad value keeps the default."""
    source, out = os.environ if env is None else env, dict(defaults)
    for name, default in defaults.items():
        text = source.get(prefix + name.upper())
        if text is None:
            continue
        try:
            if isinstance(default, bool):
                out[name] = text.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(default, (list, tuple)):
                kind = type(default[0]) if default else str
                out[name] = type(default)(kind(x) for x in text.split(",") if x.strip())
            else:
                out[name] = type(default)(text)
        except ValueError:
            continue
    return out


def expand_users(spec: str, demo: int = 25) -> list[str]:
    """User ids from a comma-separated list, or ``demo`` for numbered ones."""
    if spec.strip() == "demo":
        return [f"user_{i:03d}" for i in range(1, demo + 1)]
    return list(dict.fromkeys(u.strip() for u in spec.split(",") if u.strip()))


def number_list(text: str, n: int | None = None, kind: type = float) -> list:
    """Numbers from a comma-separated list, ``n`` of them if that is given."""
    out = [kind(x) for x in text.split(",") if x.strip()]
    if n is not None and len(out) != n:
        raise ValueError(f"{n} numbers expected in {text!r}")
    return out


def run_path(base: str, task: str, run: str | int, seed: int) -> str:
    return "/".join([base.rstrip("/"), task, f"run_{run}", f"seed_{seed}"])
