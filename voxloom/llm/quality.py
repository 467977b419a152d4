"""Quality rules with thresholds that adapt to each language and source.

Counts are taken from every whole text in one Arrow pass. Six ratios a
document, as integers, and three sizes go into a mergeable quantile sketch per language
and source: a histogram whose bins are exact below 128 and 1/64 wide above, so that
sketches merge by adding counts, in any order, and give the same quantiles
whatever the partitioning. Documents that fail the base rule stay out. The quantiles of a
group are blended with those of its language, and these with those of all, by
rows: as if PRIOR_ROWS rows of the wider group stood beside the group's own, so nothing
switches at some size. With s the spread q90 - q50, the upper fence is
q50 + s + SPREADS * max(s, unit), where the unit is what a single occurrence adds to a document of the group's median
size; the lower fence of the word length mirrors it (q10, q50). A source whose noise lifts its
own q90 does not open its fence: s is at most WIDEST times the spread of its language, so only
a median moves the fence freely. Nor does a fence of a share lie further than half-way from q50 + s to
the end of its range, however few lines or words a median text has. No cutoff is fixed.
The fences are joined back to the documents.

Defined results: a null text has no words. Null languages and sources are groups
of their own. Texts without words fail the base rule. Rows are independent, so
repeated rows and ids count as often as they occur. Equal documents of a group have
equal verdicts, and a value on the fence is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import ASCII_SPACE, checkpointed, slices, small_batches
from voxloom.llm.ngramjoin import _M1, _mix, _Words

_SPACE = ASCII_SPACE.encode()
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: Ratio: (its SQL, the size of which it is a share (in 10,000; word_length: in 100), whether there is a lower fence).
RATIOS = {
    "symbols": ("n_symbols * 10000 div word_chars", "word_chars", False),
    "upper": ("n_upper * 10000 div word_chars", "word_chars", False),
    "marks": ("n_marks * 10000 div word_chars", "word_chars", False),
    "repeats": ("n_repeat_words * 10000 div n_words", "n_words", False),
    "dup_lines": ("n_dup_lines * 10000 div n_lines", "n_lines", False),
    "word_length": ("word_chars * 100 div n_words", "n_words", True),
}
SIZES = ("word_chars", "n_words", "n_lines")
QUANTILES = (10, 50, 90)
#: Widths of the fences in spreads, and rows of the wider group that are blended into a group's.
SPREADS, PRIOR_ROWS = 6, 100
#: Spreads of the language that a source's own may reach.
WIDEST = 2
BASE_FAILED = "(n_words < 50 OR n_repeat_words * 100 > n_words * 50)"


def base_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(key, groups, COUNTS) of every row."""

    def without(data: bytes, chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for t in part.column(text).to_pylist():
                    t = t or ""
                    data = t.encode()
                    words = data.split()
                    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
                    rows.append((len(words), len(t) - without(data, _SPACE), without(data, _SYMBOLS), len(lines) - len(set(lines)), _repeated(words, known), len(lines), without(data, _UPPER), without(data, b"!")))
                counts = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
                yield pa.RecordBatch.from_arrays([part.column(key), *(part.column(g) for g in groups), *(pa.array(np.ascontiguousarray(c)) for c in counts.T)], [key, *groups, *COUNTS])

    return small_batches(docs.select(key, *groups, text)).mapInArrow(run, docs.select(key, *groups, *(F.lit(0).cast("long").alias(c) for c in COUNTS)).schema)


def _repeated(words: list[bytes], known: _Words) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(np.uint64)
    grams = _mix((h[:-2] * _M1 + h[1:-1]) * _M1 + h[2:])
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.isin(grams, twice)
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j : j + len(found)] |= found
    return int(covered.sum())


def sketch_bin(value: Column) -> Column:
    """Lower end of the value's bin: the value itself below 128, its seven leading bits above."""
    shift = F.length(F.bin(value)) - 7
    return F.when(value < 128, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))


def group_sketches(counts: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(groups, ratio, bin, n): the sketch of each group and ratio (or size). Merge by summing n."""
    values = [(name, sql) for name, (sql, _, _) in RATIOS.items()] + [(size, size) for size in SIZES]
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("ratio"), F.expr(sql).alias("value")) for name, sql in values])).alias("r")
    return counts.where(f"NOT {BASE_FAILED}").select(*groups, pairs).groupBy(*groups, F.col("r.ratio").alias("ratio"), sketch_bin(F.col("r.value")).alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ratio, rows, q10, q50, q90): from sketches merged to the groups."""
    merged = sketches.groupBy(*groups, "ratio", "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*groups, "ratio")
    ranked = merged.withColumns({"upto": F.sum("n").over(own.orderBy("bin")), "rows": F.sum("n").over(own)})
    at = {q: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, F.col("bin"))).alias(f"q{q}") for q in QUANTILES}
    return ranked.groupBy(*groups, "ratio").agg(F.max("rows").alias("rows"), *at.values())


def thresholds(sketches: DataFrame, groups: tuple[str, str] = ("lang", "source"), *, spreads: int = SPREADS, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(groups, one column ``<ratio>_high`` or ``<ratio>_low`` per fence) of every group."""
    sketches = checkpointed(sketches)
    lang, _ = groups
    own, of_lang, of_all = quantiles(sketches, list(groups)), quantiles(sketches, [lang]), quantiles(sketches, [])
    names = ("rows", *(f"q{q}" for q in QUANTILES))
    of_lang = of_lang.select(F.col(lang).alias("__lang"), F.col("ratio").alias("__r1"), *[F.col(c).alias(f"l_{c}") for c in names])
    of_all = of_all.select(F.col("ratio").alias("__r2"), *[F.col(c).alias(f"a_{c}") for c in names])
    both = own.join(of_lang, F.col(lang).eqNullSafe(F.col("__lang")) & (F.col("ratio") == F.col("__r1"))).join(of_all, F.col("ratio") == F.col("__r2"))
    blend = lambda q, rows, wider: (F.col(rows) * F.col(q) + prior_rows * wider) / (F.col(rows) + prior_rows)
    blended = {q: blend(q, "rows", blend(f"l_{q}", "l_rows", F.col(f"a_{q}"))) for q in names[1:]}
    wider = {f"l_{q}": blend(f"l_{q}", "l_rows", F.col(f"a_{q}")) for q in names[1:]}
    spread = {"s_low": F.least(blended["q50"] - blended["q10"], WIDEST * (wider["l_q50"] - wider["l_q10"])), "s_high": F.least(blended["q90"] - blended["q50"], WIDEST * (wider["l_q90"] - wider["l_q50"]))}
    kept = both.withColumns({"b_q50": blended["q50"], **{f"b_{n}": c for n, c in spread.items()}})
    wide = kept.groupBy(*groups).agg(*[F.max(F.when(F.col("ratio") == r, F.col(f"b_{q}"))).alias(f"{r}_{q}") for r in (*RATIOS, *SIZES) for q in ("q50", "s_low", "s_high")])
    fences = []
    for name, (_, size, below) in RATIOS.items():
        unit = (100 if name == "word_length" else 10_000) / F.col(f"{size}_q50")
        q50, low, high = (F.col(f"{name}_{c}") for c in ("q50", "s_low", "s_high"))
        reach = spreads * F.greatest(high, unit)
        reach = reach if name == "word_length" else F.least(reach, (10_000 - q50 - high) / 2)
        fences.append((q50 + high + reach).alias(f"{name}_high"))
        if below:
            fences.append((q50 - low - spreads * F.greatest(low, unit)).alias(f"{name}_low"))
    return wide.select(*groups, *fences)


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", groups: tuple[str, str] = ("lang", "source"), spreads: int = SPREADS, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(key, COUNTS, base_failed, kept) of every row."""
    counts = checkpointed(base_counts(docs, key=key, text=text, groups=groups))
    limits = thresholds(group_sketches(counts, groups), groups, spreads=spreads, prior_rows=prior_rows)
    limits = limits.select(*[F.col(g).alias(f"__{g}") for g in groups], *[c for c in limits.columns if c not in groups])
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    joined = counts.join(limits, on[0] & on[1], "left")
    good = F.lit(True)
    for name, (sql, _, below) in RATIOS.items():
        value = F.expr(f"CASE WHEN n_words > 0 THEN {sql} END")
        good &= value <= F.col(f"{name}_high")
        if below:
            good &= value >= F.col(f"{name}_low")
    failed = F.expr(BASE_FAILED)
    return joined.select(key, *COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(good, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, *, key: str = "doc_id", text: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """docs whose row was kept, by id; rows with a null id go."""
    kept = judge(docs, key=key, text=text, groups=groups).where("kept").select(F.col(key).alias("__good")).distinct()
    return docs.join(kept, docs[key] == kept["__good"], "left_semi")
