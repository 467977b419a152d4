"""Personal data: spans by fixed rules, and spans that boosted trees select among candidates.

All in DataFrame expressions; a document's spans are computed inside its row, so
nothing is shuffled but the counted feature combinations. High-recall generators,
at least one a kind, propose candidates that overlap each other and the rules' spans: mail
addresses also spelled with "(at)" and "(dot)", telephone numbers in groups, any run of
digits with separators, card numbers that stand in longer runs or have other separators,
and addresses of hosts with their dots in brackets. Each candidate is written in the plain form of
its kind (no plus sign and country code, plain at sign and dots), and has binned
format and context features of that form, which do not tell in which writing it was found, nor
whether it passes a check.

A candidate is an example for its kind where a rule of that kind holds it, an
example against it where a check speaks against it (digits that fail Luhn, parts above
255 or of a longer chain, a date, too few or many digits, a part of a word, a host without a
dot, a span of another kind), and no example otherwise. Those of no example are what the trees
decide on: the rules know nothing of them. A number that is no card passes Luhn one
time in ten, so failing ones stand for a ninth as many that pass, which are taken
off the examples for cards.

Over all candidates of all documents, Spark counts the combinations of bins, for and
against; the number of combinations is at most the product of the bins
(``MAX_COMBINATIONS``). Trees boosted on these counts give a probability; for each
generator the least threshold with the asked precision over candidates of held-out
texts, one more error supposed, selects those that are added where no rule's span is.
With few examples nothing reaches that precision, and nothing is added.

Defined results: null and empty texts have no spans. Offsets are code points,
end exclusive. Rows are independent; ids may be null or repeated. Columns of docs
may have any name; base_spans and spans are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm import boosting

KINDS = ("email", "ip", "card", "phone")
#: Rules and generators: (kind, what a text must contain, pattern). Possessive
#: repeats and the look-behind keep the search linear; \G stands for the end of the match before.
RULES = (
    ("email", "instr({t}, '@') > 0", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    ("ip", "{t} rlike '[0-9]'", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("card", "{t} rlike '[0-9]'", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "instr({t}, '+') > 0", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: (generator, kind of what it proposes, what a text must contain, pattern).
GENERATORS = (
    ("mail", "email", "instr({t}, '@') > 0 OR lower({t}) rlike '[(\\\\[]at[)\\\\]]'", r"(?i)(?:\G|(?<![A-Z0-9._%+-]))[A-Z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Z0-9-]+)*+"),
    ("grouped", "phone", "{t} rlike '[0-9]'", r"(?:\+ ?[0-9]{1,3}[ .-]{0,2})?\(?(?<![0-9A-Za-z])[0-9]{2,5}\)?(?:[ .-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z])"),
    ("number", "phone", "{t} rlike '[0-9]'", r"(?:\+ ?)?\(?[0-9][0-9 ().-]{5,}[0-9]"),
    ("digits", "card", "{t} rlike '[0-9][0-9][0-9][0-9]'", r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[ ./-]{1,3}[0-9]{4}){2}[ ./-]{1,3}[0-9]{1,7}|[0-9]{4}[ ./-]{1,3}[0-9]{6}[ ./-]{1,3}[0-9]{5})(?![0-9])"),
    ("dotted", "ip", "{t} rlike '[0-9]'", r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| ?(?:\(dot\)|\[dot\]) ?)[0-9]{1,3}){3}(?![0-9])"),
)
CONTEXT = 24
#: Matches whose places are summed up together.
STEP = 256
FEATURES = ("gen", "digits", "shape", "seps", "words", "dots", "before", "after")
#: 5 generators x 9 digit bins x 6 shapes x 5 x 6 x 4 x 4 x 4.
MAX_COMBINATIONS = 5 * 9 * 6 * 5 * 6 * 4 * 4 * 4
#: Passing numbers that are no cards, for each that fails Luhn.
CHANCE = 1 / 9

_VALID = {
    "email": "true",
    "ip": "forall(split(c.span, '[.]'), p -> length(ltrim('0', p)) < 3 OR (length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255'))",
    "card": "length(c.d) BETWEEN 12 AND 19 AND {luhn}",
    "phone": "length(c.d) BETWEEN 9 AND 15",
}


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _luhn(digits: str) -> str:
    one = f"cast(substr({digits}, length({digits}) - i, 1) AS int)"
    return f"(aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {one} WHEN {one} > 4 THEN 2 * {one} - 9 ELSE 2 * {one} END) % 10 = 0)"


def _found(kind: str, needs: str, pattern: str) -> dict[str, Column]:
    """The matches of a pattern, and of the text between them its lengths and ends; empty unless the text needs a search."""
    search = f"coalesce({needs.format(t='__t')}, false)"
    return {
        f"__m_{kind}": F.expr(f"CASE WHEN {search} THEN regexp_extract_all(__t, {_quoted(pattern)}, 0) ELSE CAST(array() AS array<string>) END"),
        f"__g_{kind}": F.expr(f"CASE WHEN {search} THEN transform(split(__t, {_quoted(pattern)}, -1), x -> struct(length(x) AS n, right(x, {CONTEXT}) AS tail, left(x, {CONTEXT}) AS head)) ELSE CAST(array() AS array<struct<n:int,tail:string,head:string>>) END"),
    }


def _placed(kind: str) -> Column:
    """array<struct<start, end, span, tail, head>> of the matches of a kind."""
    m, g = f"__m_{kind}", f"__g_{kind}"
    # Prefix sums over blocks of STEP matches, so that no long array is copied once a match.
    block = f"aggregate(sequence(b, least(b + {STEP - 1}, size({m}) - 1)), struct(a.at AS at, CAST(array() AS array<int>) AS out), (s, i) -> struct(s.at + {g}[i].n + length({m}[i]) AS at, concat(s.out, array(s.at + {g}[i].n)) AS out))"
    starts = f"flatten(aggregate(sequence(0, size({m}) - 1, {STEP}), struct(0 AS at, CAST(array() AS array<array<int>>) AS out), (a, b) -> transform(array({block}), r -> struct(r.at AS at, concat(a.out, array(r.out)) AS out))[0], a -> a.out))"
    return F.expr(f"CASE WHEN size({m}) > 0 THEN transform({starts}, (p, i) -> struct(p AS start, p + length({m}[i]) AS end, {m}[i] AS span, {g}[i].tail AS tail, {g}[i + 1].head AS head, regexp_replace({m}[i], '[^0-9]', '') AS d)) ELSE CAST(array() AS array<struct<start:int,end:int,span:string,tail:string,head:string,d:string>>) END")


#: The plain form of a candidate, by kind: what of the writing the features must not tell.
_PLAIN = {
    "email": r"regexp_replace(regexp_replace(lower(c.span), r' ?[(\[]at[)\]] ?', '@'), r' ?[(\[]dot[)\]] ?', '.')",
    "phone": r"regexp_replace(c.span, r'^[+] ?[0-9]{1,3}(?=[ (.-])[ .-]*', '')",
    "card": "c.span",
    "ip": r"regexp_replace(c.span, r' ?[(\[](?:[.]|dot)[)\]] ?', '.')",
}
_SEPS = "least(4, length(regexp_replace(c.plain, '[^ ().-]', '')))"
_TAIL_SHAPE = "right(regexp_replace(c.plain, '[0-9]', '9'), 8)"
_SHAPE = {
    "email": "CASE WHEN c.plain rlike '[.][a-z]{2,}$' THEN 1 ELSE 0 END",
    "phone": f"CASE {_TAIL_SHAPE} WHEN '999-9999' THEN 1 WHEN '999 9999' THEN 2 WHEN '999.9999' THEN 3 WHEN '99999999' THEN 4 ELSE CASE WHEN {_TAIL_SHAPE} rlike '^[9.]+$' THEN 5 ELSE 0 END END",
    "card": "CASE left(c.plain, 1) WHEN '4' THEN 1 WHEN '5' THEN 2 WHEN '3' THEN 3 WHEN '6' THEN 4 WHEN '2' THEN 5 ELSE 0 END",
    "ip": "0",
}
#: A candidate in the middle of a word is none; a point after it may end the sentence.
_INSIDE = "right(c.tail, 1) rlike '[0-9A-Za-z]' OR left(c.head, 1) rlike '[0-9A-Za-z]'"
#: What speaks against a candidate, by kind.
_AGAINST = {
    "email": "instr(c.plain, '.') = 0 OR NOT c.plain rlike '@[^@]*[.]'",
    "phone": f"length(c.d) NOT BETWEEN 7 AND 15 OR {_INSIDE} OR regexp_replace(c.plain, '[0-9]', '9') rlike '^(9999[-.]99?[-.]99?|99?[-.]99?[-.]9999)$'",
    "card": f"length(c.d) NOT BETWEEN 12 AND 19 OR NOT {_luhn('c.d')} OR {_INSIDE}",
    "ip": f"exists(split(c.plain, '[.]'), p -> cast(p AS int) > 255) OR {_INSIDE} OR c.head rlike '^[.][0-9]' OR c.tail rlike '[0-9][.]$'",
}


def _proposed(gen: int) -> str:
    """array<struct<start, rank, end, kind, no, f>> of a generator's candidates: whether a check speaks against each, and its binned features."""
    name, kind, _, _ = GENERATORS[gen]
    side = lambda x: f"CASE WHEN {x} = '' THEN 0 WHEN {x} rlike '^\\\\s$' THEN 1 WHEN {x} rlike '^[A-Za-z0-9]$' THEN 2 ELSE 3 END"
    tail, d = "lower(c.tail)", "c.d"
    features = f"""struct({gen} AS gen,
      CASE WHEN length({d}) >= 20 THEN 8 WHEN length({d}) >= 17 THEN 7 WHEN length({d}) >= 16 THEN 6 WHEN length({d}) >= 12 THEN 5 WHEN length({d}) >= 11 THEN 4 WHEN length({d}) >= 10 THEN 3 WHEN length({d}) >= 7 THEN 2 WHEN length({d}) >= 1 THEN 1 ELSE 0 END AS digits,
      {_SHAPE[kind]} AS shape,
      {0 if kind in ('email', 'ip') else _SEPS} AS seps,
      CASE WHEN {tail} rlike 'order|invoice|id|no[.]|version|isbn|date' THEN 5 WHEN {tail} rlike 'mail' THEN 1 WHEN {tail} rlike 'phone|tel|call|fax|mobile|contact' THEN 2 WHEN {tail} rlike 'card|visa|pay' THEN 3 WHEN {tail} rlike '\\\\bip\\\\b|host|server|addr' THEN 4 ELSE 0 END AS words,
      least(3, length(regexp_replace(substring_index(c.plain, '@', -1), '[^.]', ''))) AS dots,
      {side("right(c.tail, 1)")} AS before, {side("left(c.head, 1)")} AS after)"""
    plain = f"transform(__p_{name}, c -> struct(c.start AS start, c.end AS end, c.tail AS tail, c.head AS head, {_PLAIN[kind]} AS plain))"
    counted = f"transform({plain}, c -> struct(c.start AS start, c.end AS end, c.tail AS tail, c.head AS head, c.plain AS plain, regexp_replace(c.plain, '[^0-9]', '') AS d))"
    return f"transform({counted}, c -> struct(c.start AS start, {KINDS.index(kind)} AS rank, c.end AS end, '{kind}' AS kind, {_AGAINST[kind]} AS no, {features} AS f))"


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(__row, __base, __cand) of each row of docs.

    __row: all columns of docs, so that no name clashes; __base: array<struct<start, rank, end, kind>>
    sorted by start and kind; __cand: candidates with features.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__t"))
    found: dict[str, Column] = {}
    for name, needs, pattern in (*RULES, *((n, needs, pattern) for n, _, needs, pattern in GENERATORS)):
        found |= _found(name, needs, pattern)
    rows = rows.withColumns(found)
    rows = rows.select("__row", *[_placed(n).alias(f"__p_{n}") for n, *_ in (*RULES, *GENERATORS)])
    good = []
    for rank, kind in enumerate(KINDS):
        good.append(f"transform(filter(__p_{kind}, c -> {_VALID[kind].format(luhn=_luhn('c.d'))}), c -> struct(c.start AS start, {rank} AS rank, c.end AS end, '{kind}' AS kind))")
    cands = [_proposed(gen) for gen in range(len(GENERATORS))]
    return rows.select("__row", F.expr(f"array_sort(concat({', '.join(good)}))").alias("__base"), F.expr(f"concat({', '.join(cands)})").alias("__cand"))


_HITS = "exists(__base, b -> b.start < c.end AND c.start < b.end)"


def examples(docs: DataFrame, *, text: str = "text", folds: int = 2) -> DataFrame:
    """(held, features, p, n): candidates for and against by combination of features, those of one in ``folds`` texts apart."""
    held = F.pmod(F.xxhash64(f"__row.{text}"), F.lit(folds)) == 0
    same = "exists(__base, b -> b.kind = c.kind AND b.start < c.end AND c.start < b.end)"
    # The number of rule spans is a second use of __base: used once, inside a function of each candidate, it would be made anew for each.
    each = with_spans(docs.select(text), text).select(
        held.alias("held"),
        F.size("__base").alias("n_base"),
        F.explode(F.expr(f"transform(__cand, c -> struct(c.f AS f, CASE WHEN {same} THEN 1 WHEN c.no OR {_HITS} THEN 0 END AS y))")).alias("c"),
    )
    return each.where("c.y IS NOT NULL").groupBy("held", *[F.col(f"c.f.{n}").alias(n) for n in FEATURES]).agg(F.count_if(F.col("c.y") == 1).alias("p"), F.count_if(F.col("c.y") == 0).alias("n"), F.max("n_base").alias("most"))


def fit_selector(docs: DataFrame, *, text: str = "text", precision: float = 0.95, folds: int = 2) -> boosting.Boosted:
    """Boosted trees from the counts of all candidates of docs. At most 2 * MAX_COMBINATIONS rows reach the driver.

    Held-out candidates set, for each generator on its own, the least threshold with the asked precision.
    """
    counted = examples(docs, text=text, folds=folds).orderBy("held", *FEATURES).collect()

    def of(rows: list) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        chance = np.array([CHANCE if GENERATORS[r["gen"]][1] == "card" else 1.0 for r in rows])
        return {n: np.array([r[n] for r in rows], np.int64) for n in FEATURES}, np.array([r["p"] for r in rows], float), chance * np.array([r["n"] for r in rows], float)

    model = boosting.fit(*of([r for r in counted if not r["held"]]), precision=precision)
    for gen, (_, kind, _, _) in enumerate(GENERATORS):
        x, p, n = of([r for r in counted if r["held"] and r["gen"] == gen])
        model.thresholds[gen] = boosting.calibrated(model, x, p - n if kind == "card" else p, n, precision=precision, spare=1.0)
    return model


def find_spans(docs: DataFrame, model: boosting.Boosted | None = None, *, text: str = "text") -> DataFrame:
    """docs with base_spans and spans: arrays of (start, rank, end, kind) sorted by start, then rank.

    Of added spans that overlap, the one that begins first stays, of these the longest.
    """
    model = model or fit_selector(docs, text=text)
    docs = docs.drop("base_spans", "spans")
    enough = f"{model.sql('c.f.')} >= CASE c.f.gen {' '.join(f'WHEN {g} THEN {t!r}D' for g, t in (model.thresholds or {0: model.threshold}).items())} ELSE {model.threshold!r}D END"
    # -end: of candidates with one start the longest comes first.
    chosen = f"array_sort(transform(filter(__cand, c -> NOT c.no AND NOT {_HITS} AND {enough}), c -> struct(c.start AS start, -c.end AS below, c.rank AS rank, c.end AS end, c.kind AS kind)))"
    rows = with_spans(docs, text).select("__row", "__base", F.expr(chosen).alias("__chosen"))
    # By blocks of STEP spans, so that no long array is copied once a span.
    span = "array<struct<start:int,rank:int,end:int,kind:string>>"
    block = f"aggregate(slice(__chosen, b, {STEP}), struct(a.at AS at, CAST(array() AS {span}) AS out), (s, c) -> IF(c.start >= s.at, struct(c.end AS at, concat(s.out, array(struct(c.start AS start, c.rank AS rank, c.end AS end, c.kind AS kind))) AS out), s))"
    apart = f"flatten(aggregate(sequence(1, size(__chosen), {STEP}), struct(0 AS at, CAST(array() AS array<{span}>) AS out), (a, b) -> transform(array({block}), r -> struct(r.at AS at, concat(a.out, array(r.out)) AS out))[0], a -> a.out))"
    return rows.select("__row.*", F.col("__base").alias("base_spans"), F.expr(f"IF(size(__chosen) > 0, array_sort(concat(__base, {apart})), __base)").alias("spans"))


def redact(docs: DataFrame, model: boosting.Boosted | None = None, *, text: str = "text", mask: str = "#") -> DataFrame:
    """docs with every character of a span masked; columns named base_spans or spans go."""
    found = find_spans(docs, model, text=text)
    hidden = F.expr(f"aggregate(spans, {text}, (t, s) -> concat(left(t, s.start), repeat('{mask}', s.end - s.start), substr(t, s.end + 1)))")
    return found.withColumn(text, hidden).drop("base_spans", "spans")
