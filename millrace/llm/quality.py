"""Quality rules: compression bands over whole documents and fixed chunks.

zstandard ratios (raw bytes / compressed bytes) of the whole document and of each
fixed chunk are held against limits that depend on the length: a short text cannot
compress much, a long one always does. A ratio above its band means repetitive text,
one below it incompressible text (base64, random strings). Where a short text's ratio
doesn't tell hex or base32 from prose, the limits leave both; see Bands.

The work is one map over the documents: no shuffle, nothing broadcast, and memory
bounded by one Arrow batch.

Defined results: a null or empty text has no words, fails the base rule and is not
kept. Ties and repeated rows are judged alike, each row by itself. An empty table
gives an empty result. Extra columns are carried; a column with the name of a
measure is replaced by the measure.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready_for_python, byte_texts, slices

_SYMBOLS = b"#*$%&|<>"
_SPACES_AND_CONTINUATIONS = b" \t\n\x0b\f\r" + bytes(range(0x80, 0xC0))
_BEYOND_ASCII = bytes(range(0x80, 0x100))

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, bad_chunks long, n_chunks long, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Limits by length: (bytes below which the row holds, lowest ratio, highest ratio)."""

    #: Rows to 4096 bytes judge chunks and short texts, the rows from 4097 on whole texts alone.
    #: Low limits lie above base64 (1.15 to 1.33) from 384 bytes on, base32 (to 1.59) from 1024, and hex
    #: (to 1.96) from 3072; below these lengths clean text is as low. High ones are about the
    #: 95th percentile of prose or above; from 4 KB on more than 5 % of markup lies over them.
    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.45, 2.5),
        (256, 0.80, 2.6),
        (384, 1.14, 3.0),
        (512, 1.24, 3.5),
        (768, 1.32, 3.9),
        (1024, 1.42, 4.4),
        (1536, 1.54, 4.7),
        (2048, 1.60, 5.0),
        (3072, 1.72, 5.0),
        (4096, 1.93, 5.0),
        (4097, 1.94, 5.5),
        (8192, 1.95, 5.5),
        (16384, 1.97, 5.5),
        (float("inf"), 2.00, 6.5),
    )
    #: Low limits of texts with this part of bytes beyond ASCII: letters of 2 or 3 bytes, which no base64 or hex has.
    wide_share: float = 0.25
    wide: tuple[tuple[float, float], ...] = ((128, 0.45), (256, 0.80), (512, 0.95), (1024, 1.10), (4096, 1.20), (16384, 1.25), (float("inf"), 1.30))
    chunk_bytes: int = 4096
    #: A last chunk shorter than this is judged with the whole document only.
    least_chunk: int = 1024
    #: Part of the chunks that may lie outside their band.
    bad_share: float = 0.5
    level: int = 3

    def holds(self, n: int, ratio: float) -> bool:
        low, high = next((a, b) for most, a, b in self.whole if n < most)
        return low <= ratio <= high

    def keeps(self, text: bytes, ratio: float) -> bool:
        """holds(), or for wide texts their own low limits."""
        if self.holds(len(text), ratio):
            return True
        high = next(b for most, _, b in self.whole if len(text) < most)
        low = next(a for most, a in self.wide if len(text) < most)
        return low <= ratio <= high and len(text) - len(text.translate(None, _BEYOND_ASCII)) >= self.wide_share * len(text)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0  # covered: first position that isn't counted yet
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 3 - max(at, covered)
            covered = at + 3
    return total


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(text: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    """The measures of one text, in the order of MEASURES."""
    words = text.split()  # bytes.split() parts at exactly [\x20\x09-\x0D]
    n, repeated = len(words), repeat_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    ratio = len(text) / len(compressor.compress(text)) if text else 0.0
    step = bands.chunk_bytes
    chunks = [c for c in (text[i : i + step] for i in range(0, len(text), step)) if len(c) >= bands.least_chunk] if len(text) > step else []
    bad = sum(not bands.keeps(c, len(c) / len(compressor.compress(c))) for c in chunks)
    kept = not failed and bands.keeps(text, ratio) and bad <= bands.bad_share * len(chunks)
    return (
        n,
        len(text.translate(None, _SPACES_AND_CONTINUATIONS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        dup_lines(text),
        repeated,
        failed,
        ratio,
        bad,
        len(chunks),
        kept,
    )


def compression_bands(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """docs with the MEASURES; kept is the verdict."""
    ready_for_python(docs.sparkSession)
    names = [x.split()[0] for x in MEASURES.split(", ")]
    carried = [c for c in docs.columns if c not in names]
    schema = T.StructType(docs.select(*[F.col(f"`{c}`") for c in carried]).schema.fields + T.StructType.fromDDL(MEASURES).fields)
    fields = [pa.bool_() if kind == "boolean" else pa.float64() if kind == "double" else pa.int64() for kind in (x.split()[1] for x in MEASURES.split(", "))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for whole in batches:
            for batch in slices(whole):
                rows = [measure(x, bands, compressor) for x in byte_texts(batch.column(text))]
                found = [pa.array(x, kind) for x, kind in zip(zip(*rows), fields)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + found, names=carried + names)

    return docs.select(*[F.col(f"`{c}`") for c in carried]).mapInArrow(judge, schema)
