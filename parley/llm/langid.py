"""Language identification by compression.

For each language a raw-content dictionary for zstandard is cut from a bounded sample
of its learnable texts. A text (letters lower-cased, all else reduced to blanks) is encoded
in pieces with each dictionary, whatever its length; the language with the smallest sum wins. The score is the
logistic of the margin to the runner-up, in bytes per the root of the text's length; a
margin under ``NARROW`` sets ``rejected``, which leaves the decision to the caller (the
query's contract asks for a learned value, so ``lang_pred`` still names the best).

Sample: about ``PER_LANGUAGE`` rows of each language, chosen by a hash of id and text. A sampled text gives
its dictionary at most ``CUTS`` cuts of ``CUT`` bytes, spread evenly over the whole text; shorter texts are taken whole.
That bounds a dictionary at about 600 KB. Texts to be labelled are encoded whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; equal sums
go to the language with more rows, then the smaller name; repeated rows are labelled alike; null ids are
neither learned from nor held out; without any learnable row every text is ``und``; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._shared import crc_fold, documents, materialise

FOLDS, OUT = 4, 2
PER_LANGUAGE, CUTS, CUT = 240, 5, 500
PIECE, LEVEL, NARROW = 1500, 6, 0.15
BROADCAST_LANGUAGES = 50_000  # rows of a name and a count each; beyond that the join shuffles
NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> bytes:
    """Letters in small type, all else as blanks; empty for a text without a letter."""
    got = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return got.encode("utf-8", "replace") if any(map(str.isalpha, got)) else b""


def cuts(raw: bytes) -> bytes:
    """At most ``CUTS`` pieces of ``CUT`` bytes from all over the text."""
    if len(raw) <= CUTS * CUT:
        return raw
    step = (len(raw) - CUT) / (CUTS - 1)
    return b" ".join(raw[int(i * step) : int(i * step) + CUT] for i in range(CUTS))


def _material(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array([cuts(plain(t)) for t in batch.column("text").to_pylist()], pa.binary()))


class Encoder:
    """Sums of encoded sizes by language."""

    def __init__(self, data: dict[str, bytes]) -> None:
        self.names, self.coders = list(data), []
        for d in data.values():
            got = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            got.precompute_compress(level=LEVEL)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
            self.coders.append(zstandard.ZstdCompressor(dict_data=got, compression_params=params))

    def label(self, text: str | None) -> tuple[str, float, bool]:
        raw = plain(text)
        if not raw or not self.names:
            return "und", 0.0, True
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        sums = np.array([sum(len(c.compress(x)) for x in pieces) for c in self.coders], np.float64)
        if len(sums) == 1:
            return self.names[0], 1.0, False
        first = int(np.argmin(sums))
        margin = float(np.partition(sums, 1)[1] - sums[first]) / np.sqrt(len(raw))
        return self.names[first], float(1 / (1 + np.exp(-4 * margin))), margin < NARROW


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary of each language, languages with more rows first. The choice of texts is by hash, at an expected ``PER_LANGUAGE`` rows each."""
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != OUT))
    sizes = materialise(known.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "of"), "languages")
    sizes = F.broadcast(sizes) if sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else sizes
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = known.join(sizes, F.col("lang") == F.col("of")).where(draw < PER_LANGUAGE / F.col("n")).select("lang", "n", draw.alias("draw"), "text")
    got = rows.mapInArrow(_material, "lang string, n long, draw double, text binary").collect()
    got.sort(key=lambda r: (-r["n"], r["lang"], r["draw"], r["text"]))
    held: dict[str, list[bytes]] = {}
    for r in got:
        held.setdefault(r["lang"], []).append(bytes(r["text"]))
    out = {k: b" ".join(x for x in v if x) for k, v in held.items()}
    return {k: v for k, v in out.items() if len(v) >= 8}  # what the library takes at least


def _label(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            got = [encoder.label(t) for t in batch.column("text").to_pylist()]
            out = batch.drop_columns(["text"])
            for i, (name, kind) in enumerate((("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()))):
                out = out.append_column(name, pa.array([g[i] for g in got], kind))
            yield out

    return run


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries(docs))  # 600 KB a language at most
    rows = docs.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == OUT, F.lit(False)).alias("held_out"), "text")
    schema = rows.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    return rows.mapInArrow(_label(shared), schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return languages(documents(spark, sf_dir))
