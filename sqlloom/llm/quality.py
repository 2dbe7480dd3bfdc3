"""Quality rules: text counts and perplexity bands of a modified Kneser-Ney model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlloom.llm.common import stored, utf8

ORDER = 5  # bytes of a word and its boundary
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW_WORDS = 20, 30, 8
_FLUSH = 50_000  # distinct words held, over all languages, before their n-grams are added up
_HELD = 400_000  # distinct n-grams held, over all languages, before they are passed on
_SLICE = 16_384  # words spelled at once
_PART = 2 << 20  # bytes of text measured at once
_SLOTS = 1 << 20
_LANG_SHIFT = 40  # a key holds five bytes below its language


def text_counts(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int]]:
    """The words of a whole text, and word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = utf8(text)
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    return words, (len(text or "") - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words))


def repeated_words(words: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words inside windows that occur at least twice in the text, by 64-bit window hashes."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[j:j + n]
    order = np.sort(rolled)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, rolled), len(twice) - 1)] == rolled)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Five-byte codes of every predicted byte (each byte of a word, then its boundary), and the words' first places.

    A word is read behind four boundaries, so that no context reaches into the word before it.
    """
    pad = b" " * (ORDER - 1)
    buffer = np.frombuffer(b"".join([pad + w + b" " for w in words]), np.uint8)
    codes = np.zeros(len(buffer) - ORDER + 1, np.int64)
    for j in range(ORDER):
        codes = codes << 8 | buffer[j:j + len(codes)]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    ends = np.cumsum(sizes)
    first = ends - sizes  # code i predicts byte i + 4, so a word's first code starts at its padding
    take = np.ones(len(buffer), bool)
    for j in range(1, ORDER):
        take[ends - j] = False  # codes that would run over the end of the word
    return codes[take[:len(codes)]], np.concatenate(([0], np.cumsum(sizes - ORDER + 1)[:-1])) if len(words) else first


def spelled(counts: Counter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct five-byte codes of counted words and their counts, a slice of the words at a time."""
    words, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
    for i in range(0, len(words), _SLICE):
        codes, first = word_grams(words[i:i + _SLICE])
        yield added([(codes, np.repeat(times[i:i + _SLICE], np.diff(np.append(first, len(codes)))))])


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])
    return codes[starts], np.add.reduceat(n, starts) if len(starts) else n


def text_key(text: str | Column) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``lang`` and ``text``, every text of a language once, so that copies weigh nothing.

    Texts are compared by 128-bit hashes. Only those in a slot with a repeated hash are shuffled, after
    each task has dropped its own copies; the slots are bounded whatever the input, and a text that
    shares one by chance is shuffled for nothing but not lost.
    """
    keyed = docs.select("lang", "text", text_key("text").alias("_key")).withColumn("_slot", F.pmod(F.xxhash64("lang", "_key"), F.lit(_SLOTS)))
    again = keyed.groupBy("lang", "_key", "_slot").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_slot").distinct()
    slots = F.broadcast(stored(again, "quality-repeated"))
    copies = keyed.join(slots, "_slot", "left_semi").dropDuplicates(["lang", "_key"])
    return keyed.join(slots, "_slot", "left_anti").select("lang", "text").unionAll(copies.select("lang", "text"))


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang``, ``code`` and ``n`` over all documents: words are counted in the task, their n-grams pre-aggregated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = {}
        grams: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        new = 0

        def spell() -> None:
            for lang in list(words):
                counts = words.pop(lang)
                grams[lang] = added([*spelled(counts), *([grams[lang]] if lang in grams else [])])

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in grams.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])
            grams.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                counts = words.setdefault(lang.as_py(), Counter())
                before = len(counts)
                counts.update(utf8(text.as_py()).split())
                new += len(counts) - before
                if new > _FLUSH:
                    spell()
                    new = 0
                    if sum(len(codes) for codes, _ in grams.values()) > _HELD:
                        yield from emit()
        spell()
        yield from emit()

    return docs.select("lang", "text").mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """Interpolated modified Kneser-Ney probabilities, each order in arrays sorted by key.

    A key packs the language's number over the bytes of the n-gram, so distinct n-grams
    never collide; a lookup is one binary search per order.
    """

    languages: list[str | None]
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order from 1: keys, log10 probability
    contexts: list[tuple[np.ndarray, np.ndarray]]  # by length from 0: keys, log10 backoff

    def log10(self, codes: np.ndarray, lang: int) -> np.ndarray:
        """Log10 probability of the last byte of every five-byte code; the longest known n-gram decides."""
        total, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            keys, logs = self.grams[order - 1]
            wanted = (codes[open_] & ((1 << 8 * order) - 1)) | lang << _LANG_SHIFT
            at, hit = _find(keys, wanted)
            total[open_[hit]] += logs[at[hit]]
            open_, wanted = open_[~hit], wanted[~hit]
            keys, backs = self.contexts[order - 1]
            at, hit = _find(keys, ((wanted & ((1 << _LANG_SHIFT) - 1)) >> 8) | lang << _LANG_SHIFT)
            total[open_[hit]] += backs[at[hit]]
        total[open_] += np.log10(1 / 256)
        return total


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _discounts(counts: np.ndarray) -> np.ndarray:
    return discounts([int((counts == k).sum()) for k in (1, 2, 3, 4)])


def discounts(n: list[int]) -> np.ndarray:
    """Discounts for counts 1, 2 and 3 or more from how many n-grams have counts 1 to 4; plain values where too few are there."""
    if not all(n):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0] + [float(min(max(x, 0.05), k - 0.05)) for k, x in zip((1, 2, 3), d)])


def fit(counts: pa.Table) -> KneserNey:
    """The model of each language from its five-byte counts; shorter n-grams count their distinct left extensions."""
    languages = sorted(pa.compute.unique(counts["lang"]).to_pylist(), key=lambda x: (x is not None, x or ""))
    lang = pa.compute.index_in(counts["lang"], value_set=pa.array(languages, pa.string())).to_numpy().astype(np.int64)
    keys = counts["code"].to_numpy() | lang << _LANG_SHIFT
    order = np.argsort(keys)
    levels = [(keys[order], counts["n"].to_numpy()[order])]
    mask = (1 << _LANG_SHIFT) - 1
    for k in range(ORDER - 1, 0, -1):
        longer, n = levels[0]
        short = (longer & ((1 << 8 * k) - 1)) | (longer & ~np.int64(mask))
        seen, inverse = np.unique(short, return_inverse=True)
        kinds, raw = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        np.add.at(kinds, inverse, 1)
        np.add.at(raw, inverse, n)
        starts = ((seen & ((1 << 8 * k) - 1)) >> 8 * (k - 1)) == 32  # behind a boundary there is one extension only
        levels.insert(0, (seen, np.where(starts & (k > 1), raw, kinds)))
    grams, contexts, lower = [], [], None
    for k, (seen, n) in enumerate(levels, 1):
        context = ((seen & mask) >> 8) | (seen & ~np.int64(mask))
        ctx, inverse = np.unique(context, return_inverse=True)
        ls = seen >> _LANG_SHIFT
        cut = np.zeros(len(seen))
        for i in range(len(languages)):
            cut[ls == i] = _discounts(n[ls == i])[np.minimum(n[ls == i], 3)]
        total, kept = np.zeros(len(ctx)), np.zeros(len(ctx))
        np.add.at(total, inverse, n)
        np.add.at(kept, inverse, cut)
        back = kept / total
        if lower is None:
            below = np.full(len(seen), 1 / 256)
        else:
            at, hit = _find(lower[0], (seen & ((1 << 8 * (k - 1)) - 1)) | (seen & ~np.int64(mask)))
            below = np.where(hit, lower[1][at], 1 / 256)
        p = (n - cut) / total[inverse] + back[inverse] * below
        lower = (seen, p)
        grams.append((seen, np.log10(p).astype(np.float32)))
        contexts.append((ctx, np.log10(back).astype(np.float32)))
    return KneserNey(languages, grams, contexts)


def text_parts(texts: pa.Array, size: int = _PART) -> Iterator[tuple[int, int]]:
    """Beginnings and ends of runs of texts; the texts of one run end within the same ``size`` bytes."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.append(np.flatnonzero(np.diff(ends // size)) + 1, len(ends)).tolist()
    return zip([0, *cuts], cuts)


def measure_texts(net: KneserNey, number: dict[str | None, int], langs: list[str | None], texts: pa.Array) -> tuple[list, list, list]:
    """Counts, predicted bytes and log10 probability of some texts; a distinct word is looked up once for each language."""
    rows, lists, known = [], [], {}
    for lang, text in zip(langs, texts):
        words, counts = text_counts(text.as_py())
        index = known.setdefault(lang, {})
        lists.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
        rows.append((len(words), *counts))
    scores, sizes = {}, {}
    for lang, index in known.items():
        words, score, size = list(index), [], []
        for i in range(0, len(words), _SLICE):
            codes, first = word_grams(words[i:i + _SLICE])
            seen, inverse = np.unique(codes, return_inverse=True)
            score.append(np.add.reduceat(net.log10(seen, number[lang])[inverse], first))
            size.append(np.diff(np.append(first, len(codes))))
        if words:
            scores[lang], sizes[lang] = np.concatenate(score), np.concatenate(size)
    logs = [float(scores[g][x].sum()) if len(x) else 0.0 for g, x in zip(langs, lists)]
    return rows, [int(sizes[g][x].sum()) if len(x) else 0 for g, x in zip(langs, lists)], logs


def measure(docs: DataFrame, model: KneserNey) -> DataFrame:
    """``row`` (the document's columns), counts of every whole text and its log10 probability under its language's model."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "log10"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = box.value
        number = {x: i for i, x in enumerate(net.languages)}
        for batch in batches:
            texts, langs = batch.column(0).field("text"), batch.column(0).field("lang").to_pylist()
            done = [measure_texts(net, number, langs[i:j], texts[i:j]) for i, j in text_parts(texts)]
            rows, width, logs = ([x for part in done for x in part[k]] for k in range(3))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(width, pa.int64()), pa.array(logs, pa.float64())], names=names)

    rows = docs.select(F.struct("*").alias("row"))
    whole = [T.StructField(n, T.LongType()) for n in names[1:-1]]
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *whole, T.StructField("log10", T.DoubleType())]))


def bands(measured: DataFrame, spread: float = 8.0, grain: float = 0.005, least: float = 0.1) -> DataFrame:
    """Lower and upper log10 perplexity for each language: its median, and ``spread`` median deviations to either side.

    Every distinct text counts once, or one text with over half of a language's rows would shrink the band
    to itself. A side reaches ``least`` at the least; at sf0.1, 98 in 100 texts of a language lie within 0.08 of the median.
    Both medians are read off a histogram, so no language is gathered in a task and the bands do not
    depend on the order of rows.
    """
    base = measured.where(~F.col("base_failed") & F.col("ppl").isNotNull()).groupBy(F.col("row")["lang"].alias("lang"), "_key").agg(F.min("ppl").alias("ppl"))
    base = stored(base.select("lang", "ppl"), "quality-texts")

    def median(df: DataFrame, value: str, name: str) -> DataFrame:
        bins = df.groupBy("lang", F.round(F.col(value) / grain).cast("bigint").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy("lang")
        run = bins.withColumn("_run", F.sum("_n").over(w.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(w))
        return run.where(F.col("_run") * 2 >= F.col("_all")).groupBy(F.col("lang").alias("_l")).agg((F.min("_bin") * grain).alias(name))

    middle = median(base, "ppl", "_mid")
    off = base.join(middle, F.col("lang").eqNullSafe(F.col("_l"))).select("lang", F.abs(F.col("ppl") - F.col("_mid")).alias("_off"))
    wide = median(off, "_off", "_dev")
    reach = F.greatest(spread * (F.col("_dev") + grain), F.lit(least))
    return middle.join(wide.withColumnRenamed("_l", "_l2"), F.col("_l").eqNullSafe(F.col("_l2"))).select(
        F.col("_l").alias("_lang"), (F.col("_mid") - reach).alias("low"), (F.col("_mid") + reach).alias("high"))


def quality(docs: DataFrame, spread: float = 8.0) -> DataFrame:
    """``row`` (the document's columns, so no name can clash), counts, ``base_failed``, ``ppl`` (log10 perplexity a byte) and ``kept``.

    Counts of byte 5-grams inside words are taken by Spark over all distinct texts of each value of ``lang``; the
    model built from them has as many entries as there are distinct 5-grams, which text of one script bounds at
    some hundred thousand a language, and is broadcast.  A document is kept if the base rules hold and its
    perplexity lies within the band of its language.

    A null or empty text has no words and fails the base rules; a null ``lang`` is a language of its own; a
    null ``doc_id``, repeated rows and extra columns do no harm; an empty table gives an empty result.
    """
    model = fit(count_grams(distinct_texts(docs)).toArrow())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    measured = stored(measure(docs, model).withColumn("base_failed", failed).withColumn(
        "ppl", F.when(F.col("n_bytes") > 0, -F.col("log10") / F.col("n_bytes"))).withColumn("_key", text_key(F.col("row")["text"])), "quality")
    limits = F.broadcast(bands(measured, spread))  # one row for each language
    joined = measured.join(limits, F.col("row")["lang"].eqNullSafe(F.col("_lang")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return joined.select(*measured.drop("_key").columns, "low", "high", kept.alias("kept"))


def keep_good(docs: DataFrame, spread: float = 8.0) -> DataFrame:
    """The documents that ``quality`` keeps; columns as they come."""
    return quality(docs, spread).where("kept").select("row.*")
