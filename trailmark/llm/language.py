"""Language identification by compression.

Per language a raw-content zstandard dictionary is cut from a bounded sample of labelled rows; a text belongs to the
language whose dictionary compresses it smallest.  What is compressed is the whole text in lower case.  What the best
dictionary saves over the second, relative to the size, is the margin; short texts with a narrow one are also compressed at
other levels, and margins that stay narrow are rejected.

The sample: of each language the rows of lowest hash until ``DICTIONARY_BYTES`` of text, each text giving
``SAMPLE_CHARS`` characters at most (the bound is for the dictionary alone; predictions read whole texts).

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; without any labelled row
every text is ``und``; rows with a null id are learned from (their remainder is null) and predicted like others; ties go to
the language with more rows; :func:`identify` gives the columns it is told to keep, :func:`accepted_documents` all columns,
whatever their names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import held_out, map_text, packed, unpacked

#: Bytes of the dictionary of one language.
DICTIONARY_BYTES = 256 * 1024
#: Characters that one text gives to a dictionary.
SAMPLE_CHARS = 2048
#: Texts drawn for one language: so many are enough to fill a dictionary unless texts are very short.
SAMPLE_ROWS = 500
#: So many languages have dictionaries of full size; with more, all are learned from dictionaries that are smaller in proportion.
FULL_LANGUAGES = 50
#: Relative margin below which a text is rejected.
MARGIN = 0.002
#: At 9 the compressor searches well enough to find a dictionary's words also in texts that repeat themselves.
LEVEL = 9
#: Levels of the second opinion, and the size of a text and the margin under which it is asked for.
MORE_LEVELS, SHORT_BYTES, DOUBT = (3, 6, 12), 2048, 0.01


def encoded(text: str) -> bytes:
    """What is compressed: the text in lower case, between blanks so that its first and last word look like the others."""
    return f" {text.lower()} ".encode("utf-8", "surrogatepass")


def dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """The dictionaries of all languages of ``labelled``, from its bounded sample.

    Two passes: the first counts the rows of each language (two small columns); the second keeps rows whose hash is
    under a threshold set from that count, so that what reaches the driver has a bounded size.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    usable = labelled.where(lang.isNotNull() & text.isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().orderBy(F.desc("count"), lang_col).collect()}
    if not counts:
        return {}
    most = min(DICTIONARY_BYTES, max(1024, DICTIONARY_BYTES * FULL_LANGUAGES // len(counts)))
    # Rows in the same proportion, so that the driver holds as much as for FULL_LANGUAGES.
    n_rows = max(4, SAMPLE_ROWS * most // DICTIONARY_BYTES)
    # A hash of the text: rows in whatever order or partition give the same sample.
    draw = F.pmod(F.xxhash64(text), F.lit(1 << 30))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, math.ceil((1 << 30) * 2 * n_rows / n)))))
    drawn = (
        usable.where(draw < F.coalesce(share[lang], F.lit(0)))
        .groupBy(lang.alias("k"), draw.alias("d"))
        .agg(F.min(F.substring(text, 1, SAMPLE_CHARS)).alias("t"))
        .collect()
    )
    out = {}
    for k in counts:
        size, parts = 0, []
        for r in sorted((r for r in drawn if r["k"] == k), key=lambda r: (r["d"], r["t"]))[: 4 * n_rows]:
            raw = encoded(r["t"])
            parts.append(raw)
            size += len(raw)
            if size >= most:
                break
        # The end of a dictionary is the cheapest to refer to; all get the same number of bytes where there are enough.
        out[k] = b"".join(parts)[-most:]
    return {k: v for k, v in out.items() if len(v) >= 8}


class Classifier:
    """Smallest compressed size over raw-content dictionaries; of equal sizes the dictionary that comes first."""

    def __init__(self, contents: dict[str, bytes]):
        self.langs, self.contents = list(contents), contents
        self.at_level: dict[int, list] = {}

    def sizes(self, raw: bytes, level: int) -> list[int]:
        if level not in self.at_level:
            import zstandard as zstd

            self.at_level[level] = []
            for k in self.langs:
                d = zstd.ZstdCompressionDict(self.contents[k], dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                self.at_level[level].append(zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False).compress)
        return [len(c(raw)) for c in self.at_level[level]]

    def __call__(self, text: str) -> tuple[str, float, float]:
        """(language, score, margin)."""
        if not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        raw = encoded(text)
        sizes = self.sizes(raw, LEVEL)
        margin = _margin(sizes)
        if margin < DOUBT and len(raw) < SHORT_BYTES:
            sizes = [sum(x) for x in zip(sizes, *(self.sizes(raw, k) for k in MORE_LEVELS), strict=True)]
            margin = _margin(sizes)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        return self.langs[best], 1 - 0.5 ** (1 + 40 * margin), margin


def _margin(sizes: list[int]) -> float:
    first, second = sorted(sizes)[:2] if len(sizes) > 1 else (0, 1)
    return (second - first) / second


def identify(docs: DataFrame, contents: dict[str, bytes], text_col: str = "text", margin: float = MARGIN, keep: tuple[str, ...] | None = None, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` to keep (all but the text, unless that is kept as well) with ``lang_pred`` string, ``lang_score`` double, ``lang_accepted`` boolean."""

    def make():
        judge = Classifier(contents)

        def f(texts):
            seen = [judge(t) for t in texts]
            return [[s[0] for s in seen], [s[1] for s in seen], [s[0] != "und" and s[2] >= margin for s in seen]]

        return f

    names = ("lang_pred", "lang_score", "lang_accepted")
    out = StructType([StructField(n, k) for n, k in zip(names, (StringType(), DoubleType(), BooleanType()), strict=True)])
    kept = [c for c in docs.columns if c != text_col and c not in names] if keep is None else list(keep)
    return map_text(docs.select(*kept, text_col), make, out, pa.schema(list(zip(names, (pa.string(), pa.float64(), pa.bool_()), strict=True))), text_col, keep_text)


def accepted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is clear, with the predicted language as theirs; learned from ``docs`` itself."""
    seen = identify(packed(docs, text_col), dictionaries(docs.where(training_rows(docs, id_col)), text_col, lang_col), keep=("row",), keep_text=True)
    return unpacked(seen.where("lang_accepted"), docs.columns, text_col, **{lang_col: F.col("lang_pred")})


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """True for rows that may be learned from."""
    return ~F.coalesce(held_out(F.col(id_col)), F.lit(False))
