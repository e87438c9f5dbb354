"""Quality rules: perplexity under a modified Kneser-Ney model of each language.

The model is over the letters of words (n-grams of four symbols from a fixed alphabet of 64, in which every
character is spelled apart), so its size is bounded by the alphabet however large the corpus grows, and the
score of a word is computed once per distinct word and batch.  Spark counts the n-grams of all documents; each language's model
is held in sorted arrays of n-gram codes.  A document is rejected when its perplexity leaves its
language's band, below (boilerplate, repetition) or above (noise, another language).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import broadcast, bytes_of, held, quoted, saved, without

ORDER = 4
SYMBOLS = 64
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SIGNS = b"#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-_/=@"
# Escapes and how many digits follow: together room for every code point, in their order.
ESCAPES = (*((e, 1) for e in (28, *range(54, 60))), (60, 2), (61, 2), (62, 3), (63, 4))
MODEL_ENTRIES = SYMBOLS ** ORDER  # entries broadcast at a time: the most that one language can have
KNOWN_WORDS = 200_000  # scored words a worker remembers for a language
# Half widths of a band, below and above the median of log perplexity: so many robust standard
# deviations, and at least so large a share of the median.
LOWER, UPPER = (6.5, 0.08), (8.0, 0.5)
REPEATED_SHARE = 50
FEW_LANGUAGES = 10_000  # bands broadcast: three values each
BIN = 0.001  # of log perplexity, in the histogram behind a band


def _alphabet() -> np.ndarray:
    """Symbols of each code point, six bits each: a-z, digits and punctuation have one of their own, a capital is 27 and
    its letter, all others an escape and digits from 1 to 63.  No two characters have the same; only the word edge has a 0.
    """
    table = np.zeros(0x110000, np.uint32)
    table[97:123] = np.arange(1, 27)
    table[65:91] = 27 << 6 | np.arange(1, 27)
    table[48:58] = np.arange(44, 54)
    for i, c in enumerate(PUNCTUATION):
        table[ord(c)] = 29 + i
    rest = np.flatnonzero(table == 0)
    rest = rest[rest != 10]
    for escape, digits in ESCAPES:
        own, rest = rest[:63 ** digits], rest[63 ** digits:]
        packed = np.full(len(own), escape)
        for d in reversed(range(digits)):
            packed = packed << 6 | np.arange(len(own)) // 63 ** d % 63 + 1
        table[own] = packed
    return table


def grams_of(words: list[bytes], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all 4-grams (three symbols of context and one predicted, the word's end included)
    and the index of the word each belongs to."""
    text = b"\n\n\n" + b"\n\n\n".join(words) + b"\n"
    spelled = alphabet[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    size = 1 + sum((spelled >= 1 << bits).astype(np.int64) for bits in (6, 12, 18, 24))
    ends = np.cumsum(size)
    later = np.repeat(ends, size) - np.arange(1, ends[-1] + 1)  # symbols of the same character that follow
    s = np.repeat(spelled, size) >> (6 * later).astype(np.uint32) & 63
    code = s[:-3] << 18 | s[1:-2] << 12 | s[2:-1] << 6 | s[3:]
    end = (s[3:] == 0) & (s[2:-1] != 0)
    word = np.cumsum(end) - end
    real = (s[3:] != 0) | end
    return code[real], word[real]


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, gram, n`` over every word of every document; each task sends each n-gram once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = _alphabet()
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            words: dict[str, dict[bytes, int]] = {}
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words.setdefault(language, {})
                for w in body.split():
                    own[w] = own.get(w, 0) + 1
            for language, own in words.items():
                if not own:
                    continue
                code, word = grams_of(list(own), alphabet)
                weight = np.fromiter(own.values(), np.int64, len(own))[word]
                old = totals.get(language, (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
                keys, inverse = np.unique(np.concatenate([old[0], code]), return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, inverse, np.concatenate([old[1], weight]))
                totals[language] = (keys, sums)
        for language, (keys, sums) in totals.items():
            for at in range(0, len(keys), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(keys[part]), pa.string()), pa.array(keys[part].astype(np.int64)),
                     pa.array(sums[part])], names=["lang", "gram", "n"])

    rows = docs.select(F.coalesce(quoted(lang).cast("string"), F.lit("")).alias("lang"), bytes_of(text).alias("body"))
    return (rows.mapInArrow(work, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class KneserNey:
    """Interpolated modified Kneser-Ney over 4-grams, in sorted arrays of codes.

    Probabilities of seen n-grams are stored whole; for an unseen one the context's back-off weight
    multiplies the next lower order.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        grams, counts = grams[order].astype(np.int64), counts[order].astype(np.int64)
        levels = [(grams, counts)]
        for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before an n-gram
            keys, c = np.unique(levels[0][0] & (SYMBOLS ** n - 1), return_counts=True)
            levels.insert(0, (keys, c.astype(np.int64)))
        self.seen, self.backoff = [], []
        for keys, c in levels:
            discount = self._discounts(c)[np.minimum(c, 3)]
            contexts, inverse = np.unique(keys >> 6, return_inverse=True)
            total = np.bincount(inverse, c)
            p = (c - discount) / total[inverse]
            gamma = np.bincount(inverse, discount) / total
            lower = self._prob(keys & (SYMBOLS ** len(self.seen) - 1)) if self.seen else np.full(len(keys), 1 / SYMBOLS)
            self.backoff.append((contexts, gamma))
            self.seen.append((keys, p + gamma[inverse] * lower))

    @staticmethod
    def _discounts(counts: np.ndarray) -> np.ndarray:
        """D1, D2 and D3+ from the counts of counts; kept within (0, count)."""
        n1, n2, n3, n4 = (max(1, int((counts == k).sum())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        return np.clip(d, [0, 0.1, 0.1, 0.1], [0, 0.95, 1.95, 2.95])

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _prob(self, grams: np.ndarray, order: int | None = None) -> np.ndarray:
        n = len(self.seen) if order is None else order
        if n == 0:
            return np.full(len(grams), 1 / SYMBOLS)
        keys, p = self.seen[n - 1]
        at, known = self._find(keys, grams)
        out = p[at]
        if not known.all():
            rest = grams[~known]
            contexts, gamma = self.backoff[n - 1]
            where, have = self._find(contexts, rest >> 6)
            out[~known] = np.where(have, gamma[where], 1.0) * self._prob(rest & (SYMBOLS ** (n - 1) - 1), n - 1)
        return out

    def log10(self, grams: np.ndarray) -> np.ndarray:
        return np.log10(self._prob(grams.astype(np.int64)))


def models(counts: DataFrame) -> list[dict]:
    """Groups of languages, each with its models broadcast; a group holds at most ``MODEL_ENTRIES``."""
    spark = counts.sparkSession
    sizes = sorted((r.lang, r["count"]) for r in counts.groupBy("lang").count().collect())
    groups: list[list[str]] = []
    room = 0
    for language, n in sizes:
        if not groups or n > room:
            groups.append([])
            room = MODEL_ENTRIES
        groups[-1].append(language)
        room -= n
    out = []
    for group in groups:
        rows = counts.where(F.col("lang").isin(group)).toPandas() if group else pd.DataFrame()
        built = {k: KneserNey(v["gram"].to_numpy(), v["n"].to_numpy()) for k, v in rows.groupby("lang")}
        out.append({"languages": group, "models": broadcast(spark, built)})
    return out


def base_counts(body: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    chars = len(body.translate(None, SPACES + CONTINUATION))
    signs = len(body) - len(body.translate(None, SIGNS))
    lines = [x for x in body.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    first: dict = {}
    repeated = 0
    if len(set(windows)) < len(windows):
        marked = bytearray(len(words))
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                marked[i:i + 3] = marked[j:j + 3] = b"\1\1\1"
        repeated = sum(marked)
    return chars, signs, len(lines) - len(set(lines)), repeated


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log10_prob", "perplexity"]


def score_quality(docs: DataFrame, text: str = "text", lang: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with the base counts and the perplexity of every row."""
    counts = saved(count_grams(docs, text, lang), "quality-grams")
    groups = models(counts)
    kept = [c for c in (columns or docs.columns) if c.lower() not in ADDED]
    language = F.coalesce(quoted(lang).cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.lit(0).alias("__"), *[quoted(c) for c in kept]).alias("row"),
                       language.alias("lang"), bytes_of(text).alias("body"))
    schema = (f"row {rows.schema['row'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, "
              "n_dup_lines long, n_repeat_words long, log10_prob double")
    parts = []
    for g in groups:
        def work(batches: Iterator[pa.RecordBatch], sent=g["models"]) -> Iterator[pa.RecordBatch]:
            alphabet, own_models = _alphabet(), held(sent)
            known: dict[str, dict[bytes, float]] = {}
            for batch in batches:
                languages = batch.column(1).to_pylist()
                bodies = batch.column(2).to_pylist()
                split = [b.split() for b in bodies]
                for k in set(languages):
                    cache = known.setdefault(k, {})
                    if len(cache) > KNOWN_WORDS:
                        cache.clear()
                    own = set().union(*(w for w, x in zip(split, languages) if x == k))
                    new = list(own.difference(cache))
                    if new:
                        model = own_models.get(k)
                        code, word = grams_of(new, alphabet)
                        cache.update(zip(new, np.bincount(word, model.log10(code), len(new)).tolist()))
                scores = [sum(map(known[k].__getitem__, w)) for k, w in zip(languages, split)]
                base = [base_counts(b, w) for b, w in zip(bodies, split)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(w) for w in split], pa.int64()),
                     *[pa.array([x[i] for x in base], pa.int64()) for i in range(4)],
                     pa.array([float(x) for x in scores], pa.float64())],
                    names=["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log10_prob"])

        chosen = rows if len(groups) == 1 else rows.where(F.col("lang").isin(g["languages"]))
        parts.append(chosen.mapInArrow(work, schema))
    if len(groups) > 1:  # languages without a single word have no model
        every = [k for g in groups for k in g["languages"]]
        parts.append(rows.where(~F.col("lang").isin(every)).mapInArrow(work, schema))
    elif not groups:
        empty = rows.select("row", *[F.lit(0).cast("long").alias(c) for c in ADDED[:5]], F.lit(0.0).alias("log10_prob"))
        parts.append(empty)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    symbols = F.col("word_chars") + F.col("n_words")
    return (out.withColumn("base_failed", (F.col("n_words") < 50)
                           | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words")))
            .withColumn("perplexity", F.when(symbols > 0, F.pow(F.lit(10.0), -F.col("log10_prob") / symbols)))
            .select(*[F.col("row")[c].alias(c) for c in kept], *ADDED))


def _median(histogram: DataFrame, value: str) -> DataFrame:
    """``band_lang, m``: the least bin ``value`` with half of a language's rows at or below it."""
    whole = Window.partitionBy("band_lang")
    return (histogram.withColumn("upto", F.sum("n").over(whole.orderBy(value))).withColumn("all", F.sum("n").over(whole))
            .where("2 * upto >= all").groupBy("band_lang").agg(F.min(value).alias("m")))


def bands(scored: DataFrame, lang: str = "lang") -> DataFrame:
    """``band_lang, lower, upper``: a language's band of perplexity, over distinct scores of sound rows.

    Copies score alike, so a large group of them weighs as one.  Medians are read off a histogram of
    log perplexity: no task sees more than a language's bins.
    """
    logs = (scored.where("not base_failed and perplexity is not null")
            .select(F.coalesce(quoted(lang).cast("string"), F.lit("")).alias("band_lang"),
                    F.log("perplexity").alias("x"), "word_chars").distinct())
    bins = logs.groupBy("band_lang", F.round(F.col("x") / BIN).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    middle = _median(bins, "bin")
    away = (bins.join(middle, "band_lang").groupBy("band_lang", "m", F.abs(F.col("bin") - F.col("m")).alias("far"))
            .agg(F.sum("n").alias("n")))
    spread = middle.join(_median(away.drop("m"), "far").withColumnRenamed("m", "d"), "band_lang")
    below, above = (F.greatest(k * 1.4826 * F.col("d") * BIN, least * F.col("m") * BIN) for k, least in (LOWER, UPPER))
    return spread.select("band_lang", F.exp(F.col("m") * BIN - below).alias("lower"), F.exp(F.col("m") * BIN + above).alias("upper"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with base counts, perplexity, the band and ``kept``.

    ``kept`` is false for a base failure (fewer than 50 words, or over half of the words in repeated
    3-word windows) and outside the band of the row's language; null languages share one model, null
    and empty texts have no words and fail.  Repeated rows are judged alike; an empty table gives an
    empty table.  Columns named like the added ones are replaced.
    """
    names = [*ADDED, "lower", "upper", "kept", "band_lang"]
    docs = without(docs, [n for n in names if n.lower() not in (lang.lower(), text.lower())])
    wanted = list(columns or docs.columns)
    scored = saved(score_quality(docs, text, lang, list(dict.fromkeys([*wanted, lang]))), "quality-scores")
    key = F.coalesce(quoted(lang).cast("string"), F.lit(""))
    found = saved(bands(scored, lang), "quality-bands")
    if found.count() <= FEW_LANGUAGES:  # else there are enough languages to deal the rows out by them
        found = F.broadcast(found)
    judged = (scored.withColumn("band_lang", key).join(found, "band_lang", "left")
              .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))))
    return judged.select(*[quoted(c) for c in wanted], *ADDED, "lower", "upper", "kept")
