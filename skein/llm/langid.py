"""Languages of documents and of their blocks, by compression.

A block belongs to the language whose raw-content zstandard dictionary makes it smallest;
the confidence is the gap to the second smallest, as a share, and a narrow gap is rejected.
The dictionaries are made of a bounded sample of labelled documents. Labels are partly
wrong, so the sample is cleaned first: each half of it is classified by dictionaries of the
other half, over a few rounds, and only blocks with a clear language enter. All documents
are then classified whole, where they are read; nothing is shuffled but the sample.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ru", "zh")
#: Bounds of the training sample: documents a language, characters a document, bytes a dictionary.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 20_000
FAST_BYTES, WIDE_BYTES = 32_000, 256_000
FAST_LEVEL, WIDE_LEVEL = -3, 6
#: Cleaning: bytes of the dictionaries in each round, how many a language has, and blocks a language.
ROUNDS = (1_000, 1_000, 2_000, 8_000, 32_000)
CUTS = 4
CLEANED = 400
#: Below the first gap the wide dictionaries decide, below the second the block is rejected.
CLEAR, NARROW = 0.15, 0.004
LEAST_LETTERS = 4

# How the labels of languages are spelled.
_NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french francais français", "es": "es spa spanish espanol español castellano",
    "pt": "pt por portuguese portugues português", "nl": "nl nld dut dutch nederlands", "ru": "ru rus russian русский", "zh": "zh zho chi cmn chinese mandarin 中文",
}
LABELS = {name: code for code, names in _NAMES.items() for name in names.split()}
UNKNOWN = set("und unk unknown undetermined undefined none null nil nan na n/a n.a. mis mul zxx xx xxx ? ?? - -- other auto tbd todo missing".split()) | {"", "not available"}


def label(value: str | None) -> str | None:
    """The language code a label names, None if it names none; regions and scripts are cut off."""
    v = (value or "").strip().lower()
    if v in UNKNOWN:
        return None
    head = re.split(r"[-_ (,.;@]", v)[0]
    return LABELS.get(v) or LABELS.get(head) or head or v


_HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_CODE = re.compile(r"`[^`\n]*`|[\d>*|#]+")


def prose_blocks(text: str) -> list[tuple[int, str]]:
    """(number, prose) of the blocks that are not just headings or fenced code.

    Blocks are runs of non-blank lines, counted from 0 over all of them.
    """
    out, lines, number, fence = [], [], -1, ""
    for line in (*text.split("\n"), ""):
        s = line.strip()
        if not s:
            if lines:
                prose = [x for x in lines if x is not None]
                if prose:
                    out.append((number, " ".join(prose)))
                lines = []
            continue
        if not lines:
            number += 1
        mark = s[:3] if s.startswith(("```", "~~~")) else ""
        if mark and (not fence or fence == mark):
            fence = "" if fence else mark
            lines.append(None)
        else:
            lines.append(None if fence or _HEADING.match(line) else s)
    return out


def plain(prose: str) -> str:
    """A block as it is compressed: without code spans, numbers and marks, in lower case."""
    s = prose if prose.isascii() else unicodedata.normalize("NFC", prose)
    return " ".join(_CODE.sub(" ", s).lower().split())


class Classifier:
    def __init__(self, texts: dict[str, list[str]]):
        self.texts = {}
        for code, blocks in texts.items():  # no more than the dictionaries take
            size, kept = 0, []
            for b in blocks:
                if size < WIDE_BYTES:
                    kept.append(b)
                    size += len(b.encode()) + 1
            self.texts[code] = kept
        self._open()

    def __reduce__(self):  # compressors are made anew in each worker
        return Classifier, (self.texts,)

    def _open(self) -> None:
        raw = {code: "\n".join(blocks).encode() for code, blocks in self.texts.items()}
        self.fast = [(code, _compressor(b[:FAST_BYTES], FAST_LEVEL)) for code, b in raw.items()]
        self.wide = [(code, _compressor(b[:WIDE_BYTES], WIDE_LEVEL)) for code, b in raw.items()]

    @staticmethod
    def _least(compressors, data: bytes) -> tuple[str | None, float]:
        sizes = sorted((len(c(data)), code) for code, c in compressors)
        if len(sizes) < 2:
            return (sizes[0][1], 1.0) if sizes else (None, 0.0)
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]

    def language(self, block: str) -> tuple[str | None, float]:
        """(language, confidence) of a block; None where the gap is narrow or nothing is said."""
        text = plain(block)
        if sum(map(str.isalpha, text[:200])) < LEAST_LETTERS and sum(map(str.isalpha, text)) < LEAST_LETTERS:
            return None, 0.0
        data = text.encode("utf-8", "replace")
        code, gap = self._least(self.fast, data)
        if gap < CLEAR:
            code, gap = self._least(self.wide, data)
        return (code, gap) if gap >= NARROW else (None, gap)


def train(sample: list[tuple[str, str]]) -> Classifier:
    """A classifier from (label, text) rows, cleaned of blocks in other languages than labelled."""
    blocks: dict[str, str | None] = {}
    for code, text in sorted(sample):
        for _, prose in prose_blocks(text):
            p = plain(prose)
            if len(p.encode()) > 60:
                blocks.setdefault(p, code)
    # in the order of a hash, so that every cut of a language is a fair sample of it
    everything = sorted(blocks, key=lambda t: zlib.crc32(t.encode()))
    seen, texts = Counter(), []
    for t in everything:
        seen[blocks[t]] += 1
        if seen[blocks[t]] <= CLEANED:
            texts.append(t)
    assigned = [blocks[t] for t in texts]

    def gathered(keep) -> dict[str, list[str]]:
        by = defaultdict(list)
        for k, code in enumerate(assigned):
            if code and keep(k):
                by[code].append(texts[k])
        return {code: by[code] for code in LANGUAGES if by[code]}

    for size in ROUNDS:
        # small dictionaries first: in a large one even a few wrong labels supply every phrase
        groups = []
        for half in (0, 1):
            by = gathered(lambda k, h=half: k % 2 == h)
            groups.append([(code, [_compressor(c, FAST_LEVEL) for c in _cuts("\n".join(t).encode(), size)]) for code, t in by.items()])
        new = []
        for k, t in enumerate(texts):
            data = t.encode()
            sizes = sorted((sum(len(c(data)) for c in cs) / len(cs), code) for code, cs in groups[1 - k % 2])
            new.append(sizes[0][1] if len(sizes) > 1 and sizes[1][0] - sizes[0][0] >= 0.02 * sizes[1][0] else None)
        assigned = new
    cleaned = Classifier(gathered(lambda k: True))
    texts, assigned = everything, []
    for t in texts:
        code, gap = cleaned._least(cleaned.fast, t.encode())
        assigned.append(code if gap >= 0.02 else None)
    return Classifier(gathered(lambda k: True))


def _cuts(raw: bytes, size: int) -> list[bytes]:
    """Up to ``CUTS`` parts of that size, spread over the text."""
    most = max(1, min(CUTS, len(raw) // size))
    step = max(size, len(raw) // most)
    return [raw[i * step : i * step + size] for i in range(most)]


def _compressor(raw: bytes, level: int):
    data = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False).compress


def fit(docs: DataFrame) -> Classifier:
    """Train on at most ``SAMPLE_DOCS`` documents for each of the languages, chosen by the hash of their id."""
    named = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    code = F.element_at(named, F.lower(F.trim("lang")))
    rows = docs.select(F.xxhash64("doc_id").alias("h"), code.alias("code"), "text").filter(F.col("code").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("h", "text"))).filter(F.col("n") <= SAMPLE_DOCS)
    return train([(r[0], r[1]) for r in first.select("code", "text").collect()])


def _classify(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = model.value.language
        for batch in batches:
            out = ([], [], [], [], [])
            for doc, named, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                found = [(n, len(p), *classify(p)) for n, p in prose_blocks(text.replace("\r\n", "\n"))]
                votes, chars = Counter(x[2] for x in found if x[2]), Counter()
                for x in found:
                    chars[x[2]] += x[1]
                if not votes:
                    continue
                whole = max(votes, key=lambda x: (votes[x], chars[x], x))
                sure = [x[3] for x in found if x[2] == whole]
                rows = [(-1, whole, sum(sure) / len(found), label(named) != whole)]
                rows += [(x[0], x[2], x[3], True) for x in found if x[2] and x[2] != whole]
                for n, code, sureness, case in rows:
                    for column, x in zip(out, (doc, n, code, sureness, case)):
                        column.append(x)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "block_no", "lang", "confidence", "is_case"])

    return run


def languages(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """(doc_id, block_no, lang, confidence, is_case): the language of each document (block -1)
    and of each prose block in another language than its document's.

    A document's language is that of most of its prose blocks; of equally many the one with
    more text. ``is_case`` is false for a document whose label names its language. Null and
    blank texts, and texts without prose or of which every block is rejected, have no row.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or fit(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_classify(shared), "doc_id long, block_no long, lang string, confidence double, is_case boolean")
