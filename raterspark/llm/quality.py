"""Quality rules: repetition and length rules plus divergence from language references.

Every text is measured where it lies; only bounded reference histograms are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _kernels as K

#: Character classes, by byte (fixed values): lower, upper, digit, blank, line end,
#: sentence punctuation, quotes and brackets, symbols, other ASCII, and multi-byte letters
#: counted by their first byte. Continuation bytes are not counted.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\x0b\x0c",
    b"\n\r",
    b".,;:!?-",
    b"\"'()[]{}",
    b"#*$%&|<>",
)
N_CLASSES = len(CLASSES) + 2
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _members in enumerate(CLASSES):
    _CLASS_OF[list(_members)] = _k
_CLASS_OF[192:] = len(CLASSES) + 1
_CLASS_OF[128:192] = N_CLASSES  # continuation bytes: dropped

#: Word histograms count hashed words in so many cells; a language keeps its largest ones.
WORD_CELLS = 1 << 16
COMMON_WORDS = 128

#: A text is judged by its share of common words from the length at which one of its
#: language would lie under the limit by so many standard deviations.
DEVIATIONS = 4.0

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Rule measures of each text of a chunk, plus its words' cells and character classes."""
    n = len(off) - 1
    start, end, row = K.word_spans(raw, off)
    n_words = K.row_counts(row, n)
    h = K.span_hash(raw, start, end)
    per_text = lambda mask: np.add.reduceat(np.append(mask, 0).astype(np.int64), off[:-1]) * (off[1:] > off[:-1])
    points = (raw & 0xC0) != 0x80
    # windows of five words found twice or more in their text
    covered = np.zeros(len(h) + 1, np.int64)
    win = K.shingle_hash(h, 5)
    if len(win):
        inside = np.flatnonzero(row[4:] == row[: len(win)])
        key = win[inside]
        order = np.lexsort((key, row[inside]))
        k, r = key[order], row[inside][order]
        same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        hit = np.zeros(len(k), bool)
        hit[1:] |= same
        hit[:-1] |= same
        at = inside[order[hit]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 5, -1)
    repeated = np.bincount(row, weights=np.cumsum(covered)[:-1] > 0, minlength=n).astype(np.int64)
    # lines with a word that equal an earlier line of their text
    cut = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, off]))
    line_start, line_end = cut[:-1], cut[1:] - (raw[cut[1:] - 1] == 10) if len(raw) else cut[1:]
    dup_lines = np.zeros(n, np.int64)
    if len(line_start):
        has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
        line_start, line_end = line_start[has_word], line_end[has_word]
        line_row = np.searchsorted(off, line_start, "right") - 1
        lines = np.stack([line_row, K.span_hash(raw, line_start, line_end).view(np.int64)])
        kinds = np.unique(lines, axis=1)[0] if lines.size else lines[0]
        dup_lines = K.row_counts(line_row, n) - K.row_counts(kinds, n)
    doc_of_byte = np.repeat(np.arange(n), np.diff(off))
    classes = np.bincount(doc_of_byte * (N_CLASSES + 1) + _CLASS_OF[raw], minlength=n * (N_CLASSES + 1))
    return {
        "n_words": n_words,
        "word_chars": per_text(points & ~K.IS_SPACE[raw]),
        "n_symbols": per_text(SYMBOLS[raw]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated,
        "classes": classes.reshape(n, N_CLASSES + 1)[:, :N_CLASSES],
        "row": row,
        "cell": (K.span_hash(raw, start, end, lower=True) % np.uint64(WORD_CELLS)).astype(np.int64),
    }


def reference_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, kind, cell, n): character-class (kind 0) and hashed word (kind 1) totals.

    Each task adds up its own texts; Spark sums the tasks' rows. Null lang is its own group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, list[np.ndarray]] = {}
        for b in batches:
            raw, off = K.text_bytes(b.column(0))
            langs = b.column(1).to_pylist()
            for i, j in K.chunks(off):
                part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                start, end, row = K.word_spans(part, at)
                cell = (K.span_hash(part, start, end, lower=True) % np.uint64(WORD_CELLS)).astype(np.int64)
                names = sorted({x for x in langs[i:j]}, key=str)
                code = np.array([names.index(x) for x in langs[i:j]])
                chars = np.bincount(
                    np.repeat(code, np.diff(at)) * (N_CLASSES + 1) + _CLASS_OF[part],
                    minlength=len(names) * (N_CLASSES + 1),
                ).reshape(len(names), -1)
                words = np.bincount(code[row] * WORD_CELLS + cell, minlength=len(names) * WORD_CELLS).reshape(len(names), -1)
                for k, x in enumerate(names):
                    s = sums.setdefault(x, [np.zeros(N_CLASSES, np.int64), np.zeros(WORD_CELLS, np.int64)])
                    s[0] += chars[k, :N_CLASSES]
                    s[1] += words[k]
        for x, s in sums.items():
            for kind in (0, 1):
                cell = np.flatnonzero(s[kind])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x] * len(cell), pa.string()),
                        pa.array(np.full(len(cell), kind, np.int32)),
                        pa.array(cell.astype(np.int32)),
                        pa.array(s[kind][cell]),
                    ],
                    ["lang", "kind", "cell", "n"],
                )

    cols = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = cols.mapInArrow(run, "lang string, kind int, cell int, n long")
    return rows.groupBy("lang", "kind", "cell").agg(F.sum("n").alias("n"))


def language_references(docs: DataFrame, text_col: str, lang_col: str, min_words: int) -> dict:
    """Reference histograms by language: all classes and the COMMON_WORDS largest word cells.

    Gathered per language: N_CLASSES + COMMON_WORDS + 1 numbers. Languages with fewer than
    ``min_words`` words, and null, have no reference of their own.
    """
    counts = reference_counts(docs, text_col, lang_col).where("lang is not null")
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "cell")
    ranked = counts.withColumn("k", F.row_number().over(top)).withColumn(
        "total", F.sum("n").over(Window.partitionBy("lang", "kind"))
    )
    refs: dict[str, dict] = {}
    for r in ranked.where(f"k <= {COMMON_WORDS}").collect():
        ref = refs.setdefault(r["lang"], {0: {}, 1: {}, "words": 0})
        ref[r["kind"]][r["cell"]] = r["n"] / r["total"]
        if r["kind"] == 1:
            ref["words"] = r["total"]
    out = {}
    for lang, ref in refs.items():
        if ref["words"] < min_words:
            continue
        chars = np.zeros(N_CLASSES)
        chars[list(ref[0])] = list(ref[0].values())
        cells = np.array(sorted(ref[1]), np.int64)
        share = np.array([ref[1][c] for c in cells.tolist()])
        out[lang] = (chars, cells, np.append(share, max(0.0, 1 - share.sum())))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0..1) of each row of ``p`` to ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def least_words(common: float, few_common: float) -> float:
    """Words from which ``few_common`` of a language's share of common words, ``common``, lies
    DEVIATIONS standard deviations (binomial) under that share: shorter texts cannot be told apart."""
    return DEVIATIONS**2 * (1 - common) / (common * (1 - few_common) ** 2)


def quality_measures(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_doc_words: int = 50,
    min_reference_words: int = 1000,
    max_char_distance: float = 0.20,
    max_word_distance: float = 0.32,
    char_slack: float = 1.2,
    word_slack: float = 2.2,
    few_common: float = 0.25,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, rule measures, both distances, ``common_ratio``, the verdict
    ``kept``, and the columns ``carry`` of the input.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated 5-word windows.
    The method rejects a text of n words whose character classes lie over
    ``max_char_distance + char_slack / sqrt(n)``, or whose common words lie over
    ``max_word_distance + word_slack / sqrt(n)``, from its language's reference: a histogram
    of few words strays further from its source by chance. Below some 200 words that slack
    passes a text without any common word, so a text is also rejected whose share of common
    words is under ``few_common`` of its language's (``common_ratio`` is the one over the
    other; null under ``least_words`` of the language). The guard: texts under ``min_doc_words`` words, and languages under ``min_reference_words``
    words, are not judged by distance (distances are then null). A null or unknown language
    takes the nearest reference. Null and empty texts have no words and fail the base rule.
    Repeated rows give repeated rows; extra columns are ignored. An empty table gives none.
    """
    refs = language_references(docs, text_col, lang_col, min_reference_words)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type)]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [T.StructField(c, T.DoubleType()) for c in ("char_distance", "word_distance", "common_ratio")]
        + [docs.schema[c] for c in carry if c != id_col]
    )

    def distances(m: dict, langs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(langs)
        char, word, ratio = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
        judged = m["n_words"] >= min_doc_words
        for lang, (ref_chars, cells, ref_words) in refs.items():
            mine = np.array([x == lang or x not in refs for x in langs]) & judged
            if not mine.any():
                continue
            chars = m["classes"][mine].astype(float)
            d = js_distance(chars / np.maximum(chars.sum(axis=1, keepdims=True), 1), ref_chars)
            char[mine] = np.fmin(char[mine], d)
            slot = np.searchsorted(cells, m["cell"])
            slot[slot == len(cells)] = 0
            slot = np.where(cells[slot] == m["cell"], slot, len(cells))
            pick = mine[m["row"]]
            index = np.cumsum(mine) - 1
            hist = np.bincount(
                index[m["row"][pick]] * (len(cells) + 1) + slot[pick], minlength=mine.sum() * (len(cells) + 1)
            ).reshape(mine.sum(), -1)
            d = js_distance(hist / np.maximum(hist.sum(axis=1, keepdims=True), 1), ref_words)
            word[mine] = np.fmin(word[mine], d)
            common, words = 1 - ref_words[-1], m["n_words"][mine]
            # not to be told apart from this language: as if it had any number of common words
            d = np.where(words >= least_words(common, few_common), (words - hist[:, -1]) / (words * common), np.inf)
            ratio[mine] = np.fmax(ratio[mine], d)
        return char, word, np.where(np.isinf(ratio), np.nan, ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = K.text_bytes(b.column(1))
            langs = b.column(2).to_pylist()
            for i, j in K.chunks(off):
                m = measure(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                found = distances(m, langs[i:j])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i)]
                    + [pa.array(m[c].astype(np.int64)) for c in schema.names[1:6]]
                    + [pa.array(d, pa.float64(), from_pandas=True) for d in found]
                    + [c.slice(i, j - i) for c in b.columns[3:]],
                    schema.names,
                )

    carried = [F.col(c) for c in carry if c != id_col]
    cols = docs.select(F.col(id_col), F.col(text_col).alias("__t"), F.col(lang_col).cast("string").alias("__l"), *carried)
    out = cols.mapInArrow(run, schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    root = F.sqrt("n_words")
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance + char_slack / root) | (
        F.coalesce("word_distance", F.lit(0.0)) > max_word_distance + word_slack / root
    ) | (F.coalesce("common_ratio", F.lit(1.0)) < few_common)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)
