"""Language identification by compression.

Each language has a zstandard raw-content dictionary, filled from a bounded
sample of labelled rows. The letters of a whole text, lower-cased, are
compressed in blocks with every dictionary; the smallest total names its language. Narrow margins are
marked as rejected and score low.

Edge cases: null texts, empty texts and texts without a letter are ``und``
with score 0; ties go to the language with more training ids, then to the lesser
name; repeated rows give equal results, and an id that repeats counts once for
each of its languages, with its least text; rows with null lang or null id
never train; with no training rows every text is ``und``; other input columns
are ignored. Every language is learned; the driver holds DICTIONARY_BYTES of
each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.common import discard, id_remainder, materialise, table

#: Ids sampled for each language (least hash first) and bytes of its dictionary.
SAMPLE_ROWS = 600
DICTIONARY_BYTES = 64 << 10
#: Bytes that one sampled training row gives at most, so that a dictionary holds many texts (classified texts are whole).
PIECE_BYTES = 2000
HASHES = 1 << 40
#: Hashed ids let through to the ranking, as a multiple of the sample: so many are expected, and none are cut of a language with fewer.
LET_IN = 8
#: Texts are compressed in blocks of so many bytes, so that the dictionary still counts in long ones.
BLOCK_BYTES = 1024
LEVEL = 9
#: Below this margin (share of the smallest size) a decision is rejected.
MIN_MARGIN = 0.01

WORD = re.compile(r"[^\W\d_]+")


def learn(docs: DataFrame, rows_per_language: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Language to dictionary, from rows with a language whose crc32(id) mod 5 is not 0; languages of more ids come first."""
    train = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), 5) != 0))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)).alias("h")
    # ids, not rows, are counted: a sketch a language, so that no task ranks a language's every row
    langs = train.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    # written, so that the planner knows how small it is and does not shuffle the rows by language
    cuts = materialise(langs.select("lang", "n", (F.lit(float(LET_IN * rows_per_language)) * HASHES / F.col("n")).alias("cut")), "cuts")
    ids = train.select("doc_id", "lang", h).join(cuts, "lang").filter(F.col("h") <= F.col("cut")).groupBy("lang", "doc_id", "h").agg(F.max("n").alias("n"))
    w = W.partitionBy("lang").orderBy("h", "doc_id")
    chosen = ids.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= rows_per_language).select("doc_id", "lang", "rank", "n")
    chosen = materialise(chosen, "chosen")
    piece = F.substring(F.col("text").cast("binary"), 1, 4 * PIECE_BYTES).alias("raw")
    picked = train.select("doc_id", "lang", piece).join(chosen, ["doc_id", "lang"]).groupBy("lang", "rank", "n").agg(F.min("raw").alias("raw"))

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        """The dictionary of one language, from rows_per_language rows at most."""
        texts = rows.sort_by("rank").column("raw").to_pylist()
        raw = b"\n".join(normal(t.decode("utf-8", "ignore"))[:PIECE_BYTES] for t in texts)[:DICTIONARY_BYTES]
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "n": pa.array([rows.column("n")[0].as_py()], pa.int64()), "raw": pa.array([raw], pa.binary())})

    found = picked.groupBy("lang").applyInArrow(fill, "lang string, n long, raw binary").collect()
    discard(cuts, chosen)
    return {r.lang: bytes(r.raw) for r in sorted(found, key=lambda r: (-r.n, r.lang))}


def normal(text: str) -> bytes:
    """The lower-cased letter runs between single spaces."""
    return " ".join(WORD.findall(text.lower())).encode("utf-8", "replace")


def compressors(dictionaries: dict[str, bytes]) -> list:
    import zstandard as z

    made = []
    for raw in dictionaries.values():
        d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
    return made


def sizes(raw: bytes, made: list) -> list[int]:
    """Compressed bytes of the whole text by language."""
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c in made]


def decide(found: list[int]) -> tuple[int, float, float]:
    """Index of the smallest size, score in 0 to 1, margin."""
    best = min(range(len(found)), key=found.__getitem__)
    low = found[best]
    rest = min((x for i, x in enumerate(found) if i != best), default=low + 64)
    share = 1 / sum(math.exp(-min(60.0, (x - low) / 4)) for x in found)
    return best, share, (rest - low) / max(1, low)


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        made = compressors(dictionaries)
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py()
                if not text or not names or not letter.search(text):
                    rows.append(("und", 0.0, 0.0))
                else:
                    k, share, margin = decide(sizes(normal(text), made))
                    rows.append((names[k], share, margin))
            pred, score, margin = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m < MIN_MARGIN for m in margin], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; rows with crc32(id) mod 5 = 0 never train."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    found = identify(docs, learn(docs))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")
