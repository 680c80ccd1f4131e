"""Quality rules, and an n-gram model that says how usual a text is.

The model counts runs of ``order`` bytes (A-Z in lower case, zeros before a text's
start) over all texts, each distinct text once, and is smoothed by modified
Kneser-Ney. A run of up to six bytes is one number, a hash without collisions,
from which its context and its shorter forms follow by shifts, so counts,
discounts and back-off are Spark aggregates and joins on numbers.

Texts fall into two halves by their hash, copies into the same one. Each half is
scored by the counts of the other, so no text makes itself likely. Spark works out
the probability of every run that occurs; they are held as sorted arrays of
hashes. A language's usual range follows from the scores of its documents,
and documents outside of it are rejected on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibflow.llm.words import _LOWER, ROW, Bloom, Rolling, WordHashes, plain_words, sliced, texts, with_row
from bibflow.runtime import materialise

ORDER = 5
#: Runs that are sent to all tasks as sorted arrays of 12 bytes a run; more are joined.
MOST_RUNS = 10_000_000
#: How far from the median a language's texts may be, in scaled median deviations. Documented parameters.
LOWER, UPPER = 8.0, 8.0
#: Of the rules. Fixed values.
LEAST_WORDS, REPEAT_PERCENT, REPEAT_WIDTH = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
_GRID = 256  # steps of a bit in which medians are taken
_CHUNK, _BUFFER, _BLOCK = 1 << 18, 600_000, 100_000
_BATCH = 1 << 20  # bytes of text that a task looks at together
_LOW = np.frombuffer(_LOWER, np.uint8)
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_IN_WORD = (np.arange(256) & 0xC0 != 0x80) & ~_SPACE
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_BASE = 0x9E3779B97F4A7C15


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, and where each text begins; one more entry for the end."""
    array = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def _runs(flat: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Pieces of ``flat``: from, to, and the run of ``order`` bytes that ends at each place, as a number."""
    low = np.zeros(len(flat) + 8, np.uint8)
    low[8:] = _LOW[flat]
    for begin in range(0, len(flat), _CHUNK):
        end = min(len(flat), begin + _CHUNK)
        # Eight bytes that end at each place, as one big-endian number.
        eight = np.ndarray((end - begin,), ">u8", buffer=low.data, offset=begin + 1, strides=(1,))
        runs = eight.astype(np.uint64) & np.uint64((1 << 8 * order) - 1)
        for k in range(order - 1):
            at = starts[:-1] + k
            at = at[(at < starts[1:]) & (at >= begin) & (at < end)] - begin
            runs[at] &= np.uint64((1 << 8 * (k + 1)) - 1)
        yield begin, end, runs


def _halves(hashes: pa.Array) -> np.ndarray:
    return (hashes.to_numpy() >> 20) & 1


def _counted(docs: DataFrame, order: int) -> DataFrame:
    """``run`` (its half in the bit above its bytes) and ``n`` of the texts in ``docs`` (``_llm_hash``, ``text``)."""
    def run(stream):
        held, size = [], 0
        for batch in sliced(stream, rows=4096, size=_BATCH):
            flat, starts = _flat(batch.column("text"))
            half = _halves(batch.column("_llm_hash")).astype(np.uint64) << np.uint64(8 * order)
            for begin, end, runs in _runs(flat, starts, order):
                at = np.searchsorted(starts, np.arange(begin, end), side="right") - 1 if len(starts) > 2 else 0
                codes, found = pd.factorize(runs | half[at])
                held.append((found, np.bincount(codes)))
                size += len(found)
                if size > _BUFFER:
                    held = [_added(held)]
                    size = len(held[0][0])
                    if size > _BUFFER // 2:
                        yield from _blocks(*held[0])
                        held, size = [], 0
        if held:
            yield from _blocks(*_added(held))

    return docs.select("_llm_hash", "text").mapInArrow(run, "run bigint, n bigint")


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, found = pd.factorize(np.concatenate([r for r, _ in held]))
    return found, np.bincount(codes, np.concatenate([n for _, n in held])).astype(np.int64)


def _blocks(runs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(runs), _BLOCK):
        yield pa.RecordBatch.from_arrays(
            [pa.array(runs[k:k + _BLOCK].astype(np.int64)), pa.array(n[k:k + _BLOCK])], names=["run", "n"])


def run_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``half``, ``run`` and ``n``: how often each run of bytes occurs in the distinct texts of a half.

    ``docs`` has ``_llm_hash`` and ``text``. Texts that occur once are counted where
    they are; of others one copy is, which tasks see to before anything is
    shuffled. Texts are told apart by 64-bit hashes.
    """
    if not 1 <= order <= 6:
        raise ValueError("runs of one to six bytes are counted")
    copied = docs.where("text IS NOT NULL").groupBy("_llm_hash").agg(F.count("*").alias("n")).where("n > 1").select("_llm_hash")
    copied = materialise(copied, "copied")
    bits = docs.sparkSession.sparkContext.broadcast(Bloom.of(copied, "_llm_hash").words)

    def side(wanted: bool) -> DataFrame:
        def keep(stream):
            known = Bloom(bits.value)
            for batch in sliced(stream):
                has = known.has(batch.column("_llm_hash").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(has == wanted))
        return docs.select("_llm_hash", "text").mapInArrow(keep, "_llm_hash bigint, text string")

    once = side(True).groupBy("_llm_hash").agg(F.first("text").alias("text"))
    counted = _counted(side(False), order).unionByName(_counted(once, order))
    half, run = F.shiftright("run", 8 * order).cast("int"), F.col("run").bitwiseAND((1 << 8 * order) - 1)
    return counted.groupBy("run").agg(F.sum("n").alias("n")).select(half.alias("half"), run.alias("run"), "n")


def _discounts(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Per half, what is taken off counts of one, two, and three or more."""
    few = counts.where("n <= 4").groupBy("half", "n").agg(F.count("*").alias("m")).collect()
    out = {}
    for half in (0, 1):
        m = {r.n: r.m for r in few if r.half == half}
        if not all(m.get(k) for k in (1, 2, 3, 4)):
            out[half] = (0.5, 0.5, 0.5)  # too few counts to estimate from
            continue
        y = m[1] / (m[1] + 2 * m[2])
        raw = [k - (k + 1) * y * m[k + 1] / m[k] for k in (1, 2, 3)]
        out[half] = tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))
    return out


def run_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``half``, ``run`` and ``logp``: for each run of a half, log2 of its last byte's probability after the others.

    By the counts of the other half, with modified Kneser-Ney smoothing: shorter
    runs count by how many bytes stand before them, and below one byte all are
    equally likely. A context has at most 256 runs, and so has a shorter form, so no key is hot.
    """
    top = materialise(counts, "runs")
    levels, wanted = {order: top}, {order: top.select((1 - F.col("half")).alias("half"), "run")}
    for k in range(order - 1, 0, -1):
        short = F.col("run").bitwiseAND((1 << 8 * k) - 1).alias("run")
        levels[k] = materialise(levels[k + 1].groupBy("half", short).agg(F.count("*").alias("n")), "runs")
        wanted[k] = materialise(wanted[k + 1].select("half", short).distinct(), "wanted")
    known = None
    for k in range(1, order + 1):
        off = _discounts(levels[k])

        def cut(half: int) -> Column:
            one, two, more = (F.lit(d) for d in off[half])
            return F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)

        taken = F.when(F.col("half") == 0, cut(0)).otherwise(cut(1))
        level = levels[k].select("half", "run", "n", taken.alias("taken"))
        context = F.shiftright("run", 8).alias("context")
        contexts = level.groupBy("half", context).agg(F.sum("n").alias("total"), F.sum("taken").alias("free"))
        asked = wanted[k].select("half", "run", context).join(level, ["half", "run"], "left").join(
            contexts, ["half", "context"], "left")
        if known is None:
            asked = asked.withColumn("below", F.lit(1 / 256))
        else:
            shorter = known.withColumnsRenamed({"run": "short", "p": "below"})
            asked = asked.withColumn("short", F.col("run").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(shorter, ["half", "short"])
        seen = F.coalesce(F.col("n") - F.col("taken"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((seen + F.col("free") * F.col("below")) / F.col("total"))
        known = materialise(asked.select("half", "run", p.alias("p")), "known")
    return known.select((1 - F.col("half")).alias("half"), "run", F.log2("p").cast("float").alias("logp"))


def _per_text(marked: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    upto = np.zeros(len(marked) + 1, np.int32 if len(marked) < 1 << 31 else np.int64)
    np.cumsum(marked, out=upto[1:])
    return np.diff(upto[starts])


def _text_stats(values: list[bytes | None], hashes: WordHashes, rolling: Rolling) -> tuple[list[int], ...]:
    n_words, dup_lines, repeated = [], [], []
    for value in values:
        words = plain_words(value)
        n_words.append(len(words))
        lines = [x for x in (value or b"").split(b"\n") if x and not x.isspace()]
        dup_lines.append(len(lines) - len(set(lines)))
        n = len(words) - REPEAT_WIDTH + 1
        if n < 2:
            repeated.append(0)
            continue
        windows = rolling.of(rolling.sums(hashes.array(words)), np.arange(n), REPEAT_WIDTH)
        codes, _ = pd.factorize(windows)
        again = np.bincount(codes)[codes] > 1
        covered = np.zeros(len(words), bool)
        for k in range(REPEAT_WIDTH):
            covered[k:k + n] |= again
        repeated.append(int(covered.sum()))
    return n_words, dup_lines, repeated


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ADDED = (*_STATS, "n_bytes", "bits")


def _measured(docs: DataFrame, table: DataFrame | None, order: int) -> DataFrame:
    """All columns but ``text`` with ``_STATS``, ``n_bytes``, and ``bits`` (all bytes' together) from sorted arrays of ``table``."""
    sent = None
    if table is not None:
        held = table.toArrow()
        runs = held["run"].to_numpy() | held["half"].to_numpy().astype(np.int64) << 8 * order
        by = np.argsort(runs)
        sent = docs.sparkSession.sparkContext.broadcast((runs[by].astype(np.uint64), held["logp"].to_numpy()[by]))
    kept = [c for c in docs.columns if c not in ("text", "_llm_hash", *_ADDED)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in (*_STATS, "n_bytes")]
                          + [T.StructField("bits", T.DoubleType())])

    def run(stream):
        hashes, rolling = WordHashes(), Rolling(_BASE)
        for batch in sliced(stream, rows=4096, size=_BATCH):
            flat, starts = _flat(batch.column("text"))
            bits = np.zeros(batch.num_rows)
            if sent is not None:
                known, logp = sent.value
                half = _halves(batch.column("_llm_hash")).astype(np.uint64) << np.uint64(8 * order)
                for begin, end, runs in _runs(flat, starts, order):
                    at = np.searchsorted(starts, np.arange(begin, end), side="right") - 1
                    codes, found = pd.factorize(runs | half[at])
                    bits -= np.bincount(at, logp[np.searchsorted(known, found)][codes].astype(np.float64), batch.num_rows)
            # Code points are bytes that begin one; those of words are not white space.
            chars, symbols = (_per_text(wanted[flat], starts) for wanted in (_IN_WORD, _SYMBOL))
            n_words, dup_lines, repeated = _text_stats(texts(batch.column("text")), hashes, rolling)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept],
                 *[pa.array(x, pa.int64()) for x in (n_words, chars, symbols, dup_lines, repeated, np.diff(starts))], pa.array(bits)],
                names=[*kept, *_STATS, "n_bytes", "bits"])

    return docs.select(*kept, "_llm_hash", "text").mapInArrow(run, schema)


def _joined(docs: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """The same as ``_measured`` with a join of runs, whatever their number; Spark splits partitions of frequent runs."""
    source = materialise(with_row(docs), "numbered")

    def run(stream):
        for batch in sliced(stream, rows=4096, size=_BATCH):
            flat, starts = _flat(batch.column("text"))
            half = _halves(batch.column("_llm_hash"))
            for begin, end, runs in _runs(flat, starts, order):
                at = np.searchsorted(starts, np.arange(begin, end), side="right") - 1
                pairs = pd.DataFrame({"at": at, "run": runs.astype(np.int64)}).value_counts(sort=False).reset_index()
                index = pa.array(pairs["at"].to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(ROW).take(index), pa.array(half[pairs["at"].to_numpy()].astype(np.int32)),
                     pa.array(pairs["run"].to_numpy()), pa.array(pairs["count"].to_numpy())], names=[ROW, "half", "run", "times"])

    runs = source.select(ROW, "_llm_hash", "text").mapInArrow(run, f"{ROW} bigint, half int, run bigint, times bigint")
    bits = runs.join(table.hint("merge"), ["half", "run"]).groupBy(ROW).agg(
        F.sum(-F.col("logp").cast("double") * F.col("times")).alias("bits"))
    measured = _measured(source, None, order).drop("bits").join(bits, ROW, "left").drop(ROW)
    return measured.withColumn("bits", F.coalesce("bits", F.lit(0.0)))


def usual_range(scored: DataFrame, language: str, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """Per language ``low`` and ``high``: its median of ``bits_per_byte`` less and plus multiples of the scaled median deviation.

    Medians are those of scores in steps of 1/256 bit, counted, so they are the same in every run
    and no task holds a language's scores. A deviation below one step counts as one.
    """
    def median(rows: DataFrame, value: str, name: str) -> DataFrame:
        counted = rows.groupBy(language, value).agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(language).orderBy(value)
        all_ = Window.partitionBy(language)
        ranked = counted.select(language, value, F.sum("n").over(upto).alias("upto"), F.sum("n").over(all_).alias("all"))
        return ranked.where(F.col("upto") * 2 >= F.col("all")).groupBy(language).agg(F.min(value).alias(name))

    steps = F.round(F.col("bits_per_byte") * _GRID).cast("bigint").alias("step")
    counted = scored.where("bits_per_byte IS NOT NULL").select(language, steps).groupBy(language, "step").agg(F.count("*").alias("n"))
    counted = materialise(counted, "steps")
    middle = median(counted, "step", "middle")
    away = counted.join(middle.withColumnRenamed(language, "_llm_language"), F.col(language).eqNullSafe(F.col("_llm_language")))
    spread = median(away.select(language, F.abs(F.col("step") - F.col("middle")).alias("away"), "n"), "away", "spread")
    both = middle.join(spread.withColumnRenamed(language, "_llm_language"), F.col(language).eqNullSafe(F.col("_llm_language")))
    scale = 1.4826 * F.greatest("spread", F.lit(1))
    return both.select(
        F.col(language).alias("_llm_language"), ((F.col("middle") - lower * scale) / _GRID).alias("low"),
        ((F.col("middle") + upper * scale) / _GRID).alias("high"))


def judge(docs: DataFrame, text: str = "text", language: str = "lang", order: int = ORDER, lower: float = LOWER,
          upper: float = UPPER, most_runs: int = MOST_RUNS) -> DataFrame:
    """All columns but ``text``, with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits_per_byte, low, high,
    base_failed`` and ``kept``.

    Words are runs without ASCII white space. ``n_repeat_words`` are those in windows of three words
    found twice or more in the text. ``base_failed``: under 50 words, or over half of them repeated. ``bits_per_byte``
    is the logarithm of the perplexity; ``low`` and ``high`` are the bounds of the document's language, and
    ``kept`` says that it did not fail and lies within them.

    Null and empty texts have no words and no ``bits_per_byte`` and fail. Languages are compared as they
    are written, and no language is one of its own. Repeated rows are documents of their own, though each
    text counts once in the model. If the other half of the texts is empty, all bytes are equally
    likely. Added columns replace ones of their name, and columns named ``_llm_...`` are dropped.
    """
    added = (*_ADDED, "bits_per_byte", "low", "high", "base_failed", "kept")
    kept = [c for c in docs.columns if c not in (text, *added) and not c.startswith("_llm_")]
    source = docs.select(*kept, F.col(text).alias("text"), F.xxhash64(text).alias("_llm_hash"))
    if "text" in kept:
        raise ValueError("a column named text beside the text column cannot be kept")
    table = materialise(run_probabilities(run_counts(source.select("_llm_hash", "text"), order), order), "probabilities")
    measure = _measured if table.count() <= most_runs else _joined
    scored = measure(source, table, order)
    scored = materialise(scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes"))), "scored")
    ranges = usual_range(scored, language, lower, upper)
    judged = scored.join(ranges, F.col(language).eqNullSafe(F.col("_llm_language")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    usual = F.coalesce(F.col("bits_per_byte").between(F.col("low"), F.col("high")), F.lit(False))
    return judged.select(*kept, *_STATS, "bits_per_byte", "low", "high", failed.alias("base_failed"), (~failed & usual).alias("kept"))
