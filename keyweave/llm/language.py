"""Language identification by compression.

Each language has a raw-content dictionary of its training texts.  A text is cut into pieces, all of
them are compressed with each dictionary, and the language with the smallest sum wins.  Where the
margin to the next is narrow the answer is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyweave.llm.textkit import WIDE_SLICE, batch_of, map_batches, slices, texts_of

#: The training sample, for each language: so many texts, the first by a hash of the id; so many characters of each; so many bytes in all.
TRAINING_TEXTS, TRAINING_CHARS, DICTIONARY_BYTES = 64, 8192, 48 << 10
#: Languages at most: with the bounds above it limits what reaches the driver (128 MB) and each task (12 MB of dictionaries).
MAX_LANGUAGES = 256
PARTS = 64
PIECE_BYTES = 4096
#: Texts below this are compressed with more effort.
SHORT_BYTES = 512
REJECT_MARGIN = 0.01
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case words alone, a word that is said again and again once: the rest says nothing about the language."""
    return f" {' '.join(k for k, _ in groupby(_NOT_LETTERS.sub(' ', text.lower()).split()))} "


def held_out(id_column, modulus: int = 4, remainder: int = 2):
    """Fixed rule: rows that nothing is learned from."""
    return F.crc32(F.col(id_column).cast("string")) % modulus == remainder


def training_sample(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = TRAINING_TEXTS) -> dict[str, bytes]:
    """Dictionary content by language: bounded by texts and bytes for each language, which none of them loses to another.

    Ids are chosen without their texts: for each language the first by hash among texts of 200 to
    TRAINING_CHARS characters, then among the others.  Of a longer text the first TRAINING_CHARS
    characters are learned; predictions read whole texts.  More than MAX_LANGUAGES values of ``lang``
    are an error: no language is left out.
    """
    usable = docs.where(F.coalesce(~held_out(id_column), F.lit(False)) & F.col(lang).isNotNull() & (F.length(text) > 0))
    shares = {r.lang: r.n for r in usable.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(shares) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages to learn: {lang} must hold languages")
    size = F.length(text)
    keyed = usable.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("t"), F.col(lang).alias("lang"), (~size.between(200, TRAINING_CHARS)).cast("int").alias("odd"), F.xxhash64(F.col(id_column).cast("string")).alias("h"))
    first = Window.partitionBy("lang").orderBy("odd", "h", "id", "t")
    # one row of each id and text, so that copies of one don't use up a language's texts
    single = keyed.groupBy("lang", "id", "t", "h").agg(F.min("odd").alias("odd"))
    # the first of each part of a language before the first of all: no task is given more than PARTS times ``texts`` of them
    part = Window.partitionBy("lang", "part").orderBy("odd", "h", "id", "t")
    some = single.withColumn("part", F.pmod(F.shiftright("h", 8), F.lit(PARTS))).withColumn("n", F.row_number().over(part)).where(F.col("n") <= texts)
    chosen = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= texts).select("lang", "id", "t")
    rows = usable.select(F.col(lang).alias("lang"), F.col(id_column).alias("id"), F.xxhash64(text).alias("t"), F.substring(text, 1, TRAINING_CHARS).alias("text"), F.xxhash64(F.col(id_column).cast("string")).alias("h")).join(F.broadcast(chosen), ["lang", "id", "t"]).groupBy("lang", "id", "t", "h").agg(F.min("text").alias("text")).collect()
    content: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.text)):
        have = content.get(r.lang, b"")
        if len(have) < DICTIONARY_BYTES:
            content[r.lang] = (have + plain(r.text).encode() + b"\n")[:DICTIONARY_BYTES]
    # a longer dictionary would win by its length alone: shorter ones are repeated up to the longest
    room = max(map(len, content.values()), default=0)
    content = {k: (v * -(-room // len(v)))[:room] for k, v in content.items()}
    return dict(sorted(content.items(), key=lambda x: (-shares[x[0]], x[0])))


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        #: in the order of ``content``, which ties follow: the most frequent in training first
        self.languages = list(content)
        self.fast, self.thorough = [], []
        for lang in self.languages:
            for level, out in ((3, self.fast), (19, self.thorough)):
                words = zstd.ZstdCompressionDict(content[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=level)
                out.append(zstd.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text under each dictionary."""
        raw = plain(text).encode()
        use = self.thorough if len(raw) < SHORT_BYTES else self.fast
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        return [sum(len(f(p)) for p in pieces) for f in use]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); ties go to the language that is more frequent in training."""
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        if len(sizes) == 1:
            return self.languages[0], 1.0, False
        best, next_best = sizes[order[0]], sizes[order[1]]
        margin = (next_best - best) / max(next_best, 1)
        return self.languages[order[0]], min(1.0, 0.5 + 5 * margin), margin < REJECT_MARGIN


def identify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = TRAINING_TEXTS) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score, rejected.

    Null texts and those without a letter are ``und`` with score 0, as are all where nothing can be
    learned; a null id is not held out and not learned from.  Repeated rows get one answer each, the
    same; of equal sizes the language wins that is more frequent among learned rows, then the first by
    name.  An empty table gives an empty result; other columns aren't read.
    """
    content = training_sample(docs, id_column, text, lang, texts)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(content)
        for batch in batches:
            offsets, _ = texts_of(batch)
            for a, b in slices(offsets, WIDE_SLICE):
                part = batch.slice(a, b - a)
                found = [classifier.predict(x) for x in part.column(2).to_pylist()]
                yield batch_of(schema, doc_id=part.column(0), held_out=part.column(1), lang_pred=[x[0] for x in found], score=[x[1] for x in found], rejected=[x[2] for x in found])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(held_out(id_column), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, classify, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
