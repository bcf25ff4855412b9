"""Language identification by compression.

Each language has a raw-content dictionary of its training texts. A text is compressed
by zstandard with each of them; the language with the smallest result wins, and a narrow
margin marks the row as rejected. Before both, letters are put in lower case and every
run of other characters becomes one space, so capitals and junk don't decide.

Every language with a labelled text is learned. The dictionaries are fitted on a bounded
sample of labelled rows: at most ``ROWS_PER_LANGUAGE`` texts, each cut after ``ROW_BYTES``
characters, ``DICT_BYTES`` bytes in all (fewer if all languages would take more than
``MODEL_BYTES``), per language, chosen by a hash of the row. Every text is classified whole.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for
every text if no language could be learned. A null doc_id counts as the text '' in the
split. Equal texts get equal answers; ties go to the first language in code point order.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_LANGUAGE, ROW_BYTES, DICT_BYTES = 400, 8192, 110_000
#: All dictionaries together; with more than 64 languages each gets an equal share.
MODEL_BYTES = 64 * DICT_BYTES
LEVEL = 6
#: Relative margin below which a prediction counts as rejected.
MARGIN = 0.01
UNKNOWN = "und"

_not_letters = re.compile(r"[\W\d_]+").sub


def normal(text: str) -> bytes:
    return _not_letters(" ", text).lower().encode()


def split_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def training_sample(docs: DataFrame) -> list[tuple[str, list[str]]]:
    """Texts per language from a bounded, hash-chosen sample; about MODEL_BYTES bytes at most."""
    text = F.substring("text", 1, ROW_BYTES)
    size = F.abs(F.xxhash64("doc_id", "text").cast("double"))
    rows = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & (split_of(docs["doc_id"]) != 1))
    rows = rows.select(text.alias("text"), "lang", size.alias("h"), F.octet_length(text).alias("n"))
    counts = rows.groupBy("lang").agg(F.count("*"), F.min("h")).collect()  # one row per language
    if not counts:
        return []
    # hashes below a cut of their own keep about twice the rows wanted of each language, and one at least
    cuts = [(lang, max(2.0**63 * min(1.0, 2.0 * ROWS_PER_LANGUAGE / n), least)) for lang, n, least in counts]
    upto = docs.sparkSession.createDataFrame(cuts, "lang string, upto double")
    rows = rows.join(F.broadcast(upto), "lang").where(F.col("h") <= F.col("upto"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= ROWS_PER_LANGUAGE)
    budget = max(1, min(DICT_BYTES, MODEL_BYTES // len(counts)))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("nth")) - F.col("n")
    rows = rows.withColumn("left", F.lit(budget) - before).where(F.col("left") > 0)
    chosen: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "nth").select("lang", "text", "left").collect():
        part = r["text"].encode()[: r["left"]].decode(errors="ignore")  # the last text fills what is left
        chosen.setdefault(r["lang"], []).append(part)
    return sorted(chosen.items())


class Classifier:
    def __init__(self, sample: list[tuple[str, list[str]]], level: int = LEVEL):
        import zstandard as zstd

        self.languages = [lang for lang, _ in sample]
        self.by = []
        for _, texts in sample:
            data = zstd.ZstdCompressionDict(b"\n".join(map(normal, texts)), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.by.append(zstd.ZstdCompressor(dict_data=data, write_content_size=False).compress)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin was too narrow."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        data = normal(text)
        sizes = [len(compress(data)) for compress in self.by]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (second - sizes[best]) / second
        return self.languages[best], min(1.0, max(0.0, margin)), margin < MARGIN


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    # MODEL_BYTES of dictionaries: 7 MB
    model = docs.sparkSession.sparkContext.broadcast(training_sample(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value)
        for batch in batches:
            rows = [classifier.predict(x.as_py()) for x in batch.column(2)]
            lang, score, rejected = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(lang, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    held = (split_of(F.col("doc_id")) == 1).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    )
