import hashlib
import os
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from voxloom.llm import components, decontam, html, licenses, linededup, ngramjoin, pii, quality, spm, toxicity, urlgraph

WORDS = ("ba", "ke", "lo", "mi", "nu")
LONG = " ".join(f"w{i % 97}x{i}" for i in range(9000))
LINE = "a line that is long enough to count, by far and wide"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, doc string, c string, w string, spans string, __t string"


def texts():
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi") for b in ("n", "st", "r", "tt", "")]
    base = [" ".join(r.choice(words) for _ in range(80)) for _ in range(12)]
    near = [re.sub(r"^\S+", "changed", t) for t in base[:6]]
    more = [" ".join(t.split()[:40] + ["x"] + t.split()[40:]) for t in base[:3]]
    return [*base, *near, *more, base[0], base[0].upper(), None, "", " \n\t", "one", "two words", "Two Words", LONG, *[f"{LINE}\n{i}\n {LINE.upper()} " for i in range(6)]]


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", None, 1, "d", "c", "w", "x", "t") for i, t in enumerate(texts())]
    rows += [rows[3], (None, texts()[1], None, None, None, None, None, None, None, None, None), (2, "another text under the same id", "en", "s", 3, 1, "d", "c", "w", "x", "t")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_spm_matches_library(spark, messy):
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.model_path())
    made = spm.codec(spm.model_path())
    r = random.Random(1)
    letters = [*"  abcdethe▁\n\t.é中😀\x00<0x0A>", "   ", "tion", "<s>"]
    for t in [*[x or "" for x in texts()], *["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(1500)], "ab" * 5000, " " * 900]:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert made.encode(t) == ids
        assert made.decode(ids) == lib.decode(ids) == made.encode_packed(t)[1].decode()
    back = spm.decode(spm.encode(messy)).select("doc_id", "text").collect()
    assert sorted((b["text"] or "") for b in back) == sorted((m["text"] or "") for m in messy.collect())
    assert spm.digests(messy).count() == messy.count()


def jaccard(rows, n, percent):
    sets = []
    for i, t in rows:
        w = t.encode().lower().split() if t else []
        sets.append((i, frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sets, find


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join_matches_brute_force(messy, n, percent):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect() if r["doc_id"] is not None]
    sets, find = jaccard(rows, n, percent)
    want = sorted((i, len(s), find(i) if s else i) for i, s in sets)
    got = sorted((r[0], r[1], r[2]) for r in ngramjoin.jaccard_components(messy, n=n, percent=percent).collect() if r[0] is not None)
    assert got == want


def test_ngram_join_of_large_groups_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    base = [f"t{i}" for i in range(70)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(70)] = f"n{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", 25)
    sets, find = jaccard(rows, 4, 85)
    got = {x[0]: x[2] for x in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i, _ in sets}


def test_large_group_around_one_text_is_settled_by_a_few_rows(spark, monkeypatch):
    """Copies that link with the text they come from, but not with each other, leave few open rows."""
    r = random.Random(9)
    rows = []
    for c, copies in enumerate((220, 60)):
        base = [f"c{c if i > 60 else 0}t{i}" for i in range(200)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(copies):
            w = list(base)
            for at in r.sample(range(5, 195, 8), 3):
                w[at] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets, find = jaccard(rows, 4, 85)
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x[0]: x[2] for x in ngramjoin.jaccard_components(docs).collect()}
    assert got == {i: find(i) for i, _ in sets}
    of = ngramjoin.set_digests(docs, 4).withColumn("group", F.when(F.col("doc") < 221, 0).otherwise(1).cast("long")).withColumns({"parts": F.lit(6).cast("long"), "few": F.lit(16).cast("long")})
    task = F.struct(F.lit(0).cast("long").alias("task"), F.lit(0).cast("long").alias("group"), F.lit(0).alias("side"))
    grams = ngramjoin._sets_of(docs, of, 4, "doc_id", "text", task).select("doc", "s1", "s2", "grams")
    links, known = ngramjoin.settled(of, grams, 85)
    held = dict(sets)
    assert all(185 * len(held[a] & held[b]) >= 85 * (len(held[a]) + len(held[b])) for a, b in map(tuple, links.collect()))
    assert known.count() == len(rows) and known.where("open").count() <= 5


@pytest.mark.parametrize("grams", [700, 5_000])
def test_large_group_of_clusters_and_lone_rows(spark, monkeypatch, grams):
    """Whatever is tied by hand: every link between different texts counts, also of rows that the first rows leave open."""
    r = random.Random(4)
    rows = []
    for i in range(150):
        cluster = i % 7
        w = [f"k{cluster}w{j}" for j in range(60)]
        for _ in range(r.randint(0, 4) if cluster else 30):
            w[r.randrange(60)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ngramjoin, "BLOCK_GRAMS", grams)
    sets, find = jaccard(rows, 4, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = ngramjoin.set_digests(docs, 4).groupBy("s1", "s2").agg(F.min("doc").alias("doc"), F.max("n_shingles").alias("n_shingles")).withColumn("group", F.lit(5).cast("long"))
    links = ngramjoin._group_links(groups.select("doc", "group", "n_shingles", "s1", "s2"), docs, 4, 85, "doc_id", "text")
    found = dict(map(tuple, components.connected_components(links).collect()))
    heads = {x["doc"] for x in groups.collect()}
    assert all(found.get(i, i) == find(i) for i in heads)


def test_range_digests_miss_no_pair():
    r = np.random.default_rng(2)
    for size in (6, 8, 11, 14, 20, 45, 130, 700):
        for _ in range(40):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            odd = (15 * 2 * size) // 185
            b = np.unique(np.concatenate([r.permutation(a)[odd // 2 :], r.integers(0, 2**63, odd - odd // 2).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 185 * shared >= 85 * (len(a) + len(b)) and len(a) + len(b) != 2 * shared:
                assert len(np.intersect1d(*(np.concatenate(ngramjoin.range_digests(x, 85)) for x in (a, b))))


@pytest.mark.parametrize("percent", [80, 85])
def test_range_digests_of_long_texts_miss_no_pair(percent):
    r = np.random.default_rng(5)
    for size in (800, 1500, 5_000, 20_000):
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            odd = (100 - percent) * 2 * size // (100 + percent)
            b = np.unique(np.concatenate([r.permutation(a)[odd // 2 :], r.integers(0, 2**63, odd - odd // 2).astype(np.uint64)]))
            assert (100 + percent) * len(np.intersect1d(a, b)) >= percent * (len(a) + len(b))
            assert len(np.intersect1d(*(np.concatenate(ngramjoin.range_digests(x, percent)) for x in (a, b))))


def test_chance_that_ranges_miss_a_pair_is_bounded():
    """Balls in bins: few ranges are missed as often as the bound says at most; the classes keep to the limit or to the pigeonhole."""
    r = np.random.default_rng(6)
    for k, odd, shared in ((6, 12, 20), (10, 25, 60), (12, 24, 12)):
        hit = [np.setdiff1d(r.integers(0, k, shared), r.integers(0, k, odd)).size == 0 for _ in range(4_000)]
        assert 0 < np.mean(hit) <= 2 ** ngramjoin._missed(k, odd, shared) + 0.03
    for percent in (80, 85):
        starts = ngramjoin._classes(percent)
        for lower in range(60):
            least, top = starts[lower], starts[lower + 1] - 1
            odd = (100 - percent) * (top + top * 100 // percent) // (100 + percent)
            k, _ = ngramjoin._ranges(lower, percent)
            assert not odd or k > odd or ngramjoin._missed(k, odd, 2 * percent * least // (100 + percent)) <= -63.9


def test_long_texts_with_a_shared_passage_are_not_tied(spark):
    """A passage that makes up three tenths of long texts ties none, and what lies near the threshold is found."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(1200)]
    docs = spark.createDataFrame([(i, " ".join(passage + [f"d{i}w{j}" for j in range(2800)])) for i in range(10)], "doc_id long, text string")
    assert ngramjoin._ties(docs, 5, 80, "doc_id", "text").count() == 0
    rows = []
    for i in range(48):
        w = passage + [f"b{i % 4}w{j}" for j in range(1800)]
        for at in r.sample(range(10, 2990, 10), r.randint(50, 80)):
            w[at] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets, find = jaccard(rows, 5, 80)
    got = {x[0]: x[2] for x in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80).collect()}
    assert got == {i: find(i) for i, _ in sets} and len(set(got.values())) > 4


def test_near_copies_of_one_class_are_compared_once(spark, monkeypatch):
    r = random.Random(5)
    base = [[f"w{r.randrange(5000)}" for _ in range(150)] for _ in range(12)]
    texts = [" ".join([*b[:k], f"new{k}", *b[k + 1 :]]) for b in base for k in (0, 60, 149)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, sets_of = [], ngramjoin._sets_of
    monkeypatch.setattr(ngramjoin, "_sets_of", lambda docs, wanted, *more: seen.append(wanted.count()) or sets_of(docs, wanted, *more))
    got = {x["doc_id"]: x["component_id"] for x in ngramjoin.jaccard_components(docs).collect()}
    assert got == {i: i - i % 3 for i in range(36)}
    # Each document's set goes to one task, not also to that of the class below.
    assert seen == [36]


def test_tied_texts_are_shuffled_once(spark, monkeypatch):
    from voxloom.llm import common

    docs = spark.createDataFrame([(i, f"some words of text {i % 7}") for i in range(60)], "doc_id long, text string").repartition(3)
    own = ngramjoin.set_digests(docs, 4).where("doc < 40").select("doc", "s1", "s2").localCheckpoint()
    task = F.struct(F.pmod("doc", F.lit(3)).alias("task"), F.lit(0).cast("long").alias("group"), F.lit(0).alias("side"))
    found = {}
    for ids in (1_000_000, 0):
        monkeypatch.setattr(common, "BROADCAST_IDS", ids)
        rows = ngramjoin._sets_of(docs, own, 4, "doc_id", "text", task)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        found[ids] = sorted(map(str, rows.collect()))
        assert plan.count("Join Inner") == 1 and plan.count("Join LeftSemi") == (1 if ids else 0)
    assert found[0] == found[1_000_000] and len(found[0]) == 40


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 205), (None, 3)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[205] == 200


def test_line_dedup_matches_brute_force(messy):
    rows = messy.collect()
    held = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(line.strip(" \t\n\x0b\x0c\r")) >= 40 and r["doc_id"] is not None:
                held.setdefault(key(line), set()).add(r["doc_id"])
    want = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        stay = [x for x in lines if r["doc_id"] is None or len(held.get(key(x), ())) < 5 or max(held[key(x)]) == r["doc_id"]]
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    got = [(-1 if r[0] is None else r[0], r[1], r[2], r[3]) for r in linededup.line_report(messy).collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)
    assert linededup.drop_common_lines(messy).columns == messy.columns


def test_decontamination_matches_brute_force(spark, messy):
    pieces = texts()
    items = [(0, " ".join(pieces[0].split()[5:30])), (1, pieces[1]), (2, "two words"), (3, None), (4, "!!"), (5, "never seen at all in here"), (6, " ".join(pieces[2].split()[:20] + ["zz", "yy"])), (None, pieces[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\W_]+", t.lower()) if t else []
    want = set()
    for i, t in items:
        w = split(t)
        n = min(5, len(w))
        own = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
        for r in messy.collect():
            d = split(r["text"])
            there = {tuple(d[j : j + n]) for j in range(len(d) - n + 1)} if n else set()
            if own and i is not None and r["doc_id"] is not None and len(own & there) * 100 >= 80 * len(own):
                want.add((r["doc_id"], i, len(own), len(own & there)))
    assert {tuple(x) for x in decontam.find_items(messy, bench).collect()} == want and len(want) > 5
    assert decontam.drop_contaminated(messy, bench).columns == messy.columns
    assert not decontam.find_items(messy, bench.limit(0)).count()


def test_spm_cache_is_bounded_in_bytes(monkeypatch):
    """Texts of long chunks do not fill a worker, and what goes from the cache changes no result."""
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.model_path())
    monkeypatch.setattr(spm.PieceCodec, "MAX_BYTES", 200_000)
    made, rng = spm.PieceCodec(spm.model_path()), random.Random(3)
    for i in range(120):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.choice((3, 50, 300)))) for _ in range(6)) + " common words"
        assert made.encode(text) == [lib.bos_id(), *lib.encode(text), lib.eos_id()]
        for kept in (made.chunks, made.older):
            assert sum(made.CHUNK_BYTES + 4 * len(c) + len(a) + len(b) for c, (a, b) in kept.items()) <= made.MAX_BYTES
    assert made.older
    long = "k" * 5000
    assert made.encode(long) == [lib.bos_id(), *lib.encode(long), lib.eos_id()] and not any(long in c for c in (*made.chunks, *made.older))
    made.forget()
    assert not made.held and not made.chunks and not made.older


def test_pii_spans(spark, messy):
    rows = [(0, "mail a.b+c@x-y.co.uk, d@e f@g.h@i.j; 10.0.0.255 1.2.3.999 1.2.3.4.5"), (1, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (988) 555-2485 +12"), (2, "é" * 5000 + " z@q.io"), (3, None), (4, ""), (5, "9" * 4000 + "@" * 50), (6, "+1.2.3.4 5.6.7.8-9 0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    def base(t):
        out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[ -]", "", m[0])
            out += [(m.start(), 2, m.end(), "card")] if 12 <= len(d) <= 19 and luhn(d) else []
        out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(out)

    for r in pii.find_spans(df).collect():
        assert [tuple(s) for s in r["base_spans"]] == base(r["text"] or "")
        assert set(map(tuple, r["base_spans"])) <= set(map(tuple, r["spans"]))
    assert "4111 1111" not in pii.redact(df).where("doc_id = 1").first()["text"]
    assert pii.find_spans(messy).count() == messy.count()


def test_pii_added_spans(spark):
    """What no rule knows is found by what other writings of its kind taught, and look-alikes are left alone."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def no_card():
        return next(d for d in iter(lambda: rng.choice("01789") + digits(15), None) if not luhn(d))

    def host(dot):
        return dot.join(str(rng.randint(1, 255)) for _ in range(4))

    def phone():
        return f"({rng.randint(200, 999)}) 555-{digits(4)}"

    rows, planted = [], set()
    for i in range(900):
        rule = [f"+1 {phone()}", card(), host("."), f"a{digits(3)}.b@mail{rng.randint(0, 9)}.example.com"][i % 4]
        against = [f"on 20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)} it", f"order {no_card()} went", f"version {rng.randint(256, 999)}.{host('.').split('.', 1)[1]}", "see user@localhost now"][i // 4 % 4]
        text = f"word {rule} and then {against} more words"
        if i % 3 == 0:
            kind, plant = [("phone", phone()), ("card", f"{no_card()} {card()}"), ("ip", host("[.]")), ("email", f"c{digits(3)} (at) mail{rng.randint(0, 9)} (dot) example (dot) com")][i // 3 % 4]
            text += f" then {plant} at the end"
            start = text.index(plant) + (17 if kind == "card" else 0)
            planted.add((i, start, text.index(plant) + len(plant), kind))
        elif i % 3 == 1:
            text += f" then 12{digits(3)}a{digits(7)} or 201{digits(1)}-0{rng.randint(1, 9)}-2{digits(1)} or id{digits(9)}"
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit_selector(df)
    added = {(r["doc_id"], s["start"], s["end"], s["kind"]) for r in pii.find_spans(df, model).collect() for s in r["spans"] if s not in r["base_spans"]}
    assert len(added & planted) >= 0.95 * len(planted), (sorted(planted - added)[:12], [rows[p[0]][1][p[1] - 10 : p[2] + 5] for p in sorted(planted - added)[:12]])
    assert len(added & planted) >= 0.95 * len(added)
    for kind in pii.KINDS:
        own = {p for p in planted if p[3] == kind}
        assert len(added & own) >= 0.9 * len(own), kind
    # A few examples do not reach the asked precision, so nothing is added.
    few = df.where("doc_id < 12")
    assert all(r["spans"] == r["base_spans"] for r in pii.find_spans(few).collect())


def test_pii_long_texts_and_clashing_names(spark):
    text = "1" * 1_000_000 + " x@y.zz " + "4111 1111 1111 1111, " * 2000
    df = spark.createDataFrame([(1, text, "a", "b", "c", "d")], "doc_id long, text string, __t string, __base string, __cand string, __row string")
    got = pii.find_spans(df).first()
    assert (got["__t"], got["__base"], got["__cand"], got["__row"]) == ("a", "b", "c", "d")
    places = [(m.start(), 2, m.end(), "card") for m in re.finditer("4111 1111 1111 1111", text)]
    assert [tuple(x) for x in got["base_spans"]] == [(1_000_001, 0, 1_000_007, "email"), *places][: len(got["base_spans"])] and len(got["base_spans"]) == 2001
    spans = got["spans"]
    assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:]))


def plain_counts(t):
    """The six counts of the contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    held = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 2000 else set()
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(held), failed


def bin_of(v):
    return v if v < 128 else v >> (v.bit_length() - 7) << (v.bit_length() - 7)


def test_quality_matches_brute_force(spark):
    r = random.Random(8)
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}") for i, t in enumerate(texts())]
    for i in range(400):
        words = [r.choice(WORDS) + r.choice(WORDS) + str(r.randrange(90)) * (r.random() < 0.1) for _ in range(r.randint(20, 120))]
        if i % 20 == 7:
            words = [w + "#$%" for w in words]
        if i % 20 == 11:
            words = [w.upper() * 3 for w in words]
        if i % 25 == 3:
            words += words[:30]
        rows.append((1000 + i, ("\n" if i % 2 else " ").join(words) + " a & b", ("en", "de", None)[i % 3], ("a", "b", "rare")[(i % 7 == 0) + (i % 97 == 0)]))
    rows += [rows[-1], (None, rows[-2][1], "en", "a"), (5000, None, "en", None)]
    got = sorted(map(tuple, quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=str)
    counts = [plain_counts(t or "") for _, t, _, _ in rows]
    groups: dict = {}
    values = []
    for (_, t, lang, source), c in zip(rows, counts, strict=True):
        t = t or ""
        upper, marks, lines = len(re.findall("[A-Z]", t)), t.count("!"), len([x for x in t.split("\n") if x.strip()])
        own = {"symbols": c[2] * 10000 // c[1], "upper": upper * 10000 // c[1], "marks": marks * 10000 // c[1], "repeats": c[4] * 10000 // c[0], "dup_lines": c[3] * 10000 // lines, "word_length": c[1] * 100 // c[0], "word_chars": c[1], "n_words": c[0], "n_lines": lines} if c[0] else {}
        values.append(own)
        if not c[5]:
            for group in ((lang, source), (lang,), ()):
                for name, v in own.items():
                    groups.setdefault((group, name), []).append(bin_of(v))
    def q(group, name, percent):
        found = sorted(groups[group, name])
        exact = found[-(-len(found) * percent // 100) - 1]
        return (len(found) * exact + 100 * q(group[:-1], name, percent)) / (len(found) + 100) if group else exact
    want, fences = [], {}
    for (i, _, lang, source), c, own in zip(rows, counts, values, strict=True):
        good = not c[5]
        for name, (_, size, below) in quality.RATIOS.items() if good else ():
            key = (lang, source), name
            if key not in fences:
                unit = (100 if name == "word_length" else 10000) / q((lang, source), size, 50)
                q10, q50, q90 = (q((lang, source), name, x) for x in (10, 50, 90))
                w10, w50, w90 = (q((lang,), name, x) for x in (10, 50, 90))
                high, low = min(q90 - q50, 2 * (w90 - w50)), min(q50 - q10, 2 * (w50 - w10))
                reach = 6 * max(high, unit) if name == "word_length" else min(6 * max(high, unit), (10000 - q50 - high) / 2)
                fences[key] = q50 + high + reach, q50 - low - 6 * max(low, unit) if below else -1
            good &= fences[key][1] <= own[name] <= fences[key][0]
        want.append((i, *c, good))
    assert got == sorted(want, key=str)
    assert {w[-2:] for w in want} == {(True, False), (False, False), (False, True)}
    assert all(len({f[0] for (g, n), f in fences.items() if n == name}) > 1 for name in quality.RATIOS)


def test_noisy_sources_do_not_open_their_fences(spark):
    r = random.Random(21)
    plain = lambda n=90: [r.choice(WORDS) + r.choice(WORDS) + r.choice("abcdefgh") + str(r.randrange(400)) for _ in range(n)]
    bad = {
        "symbols": lambda: [w + "#$%" for w in plain()],
        "upper": lambda: [w.upper() for w in plain()],
        "marks": lambda: [w + "!!" for w in plain()],
        "word_length": lambda: [w * 4 for w in plain()],
        "short": lambda: ["a" + w[0] for w in plain(200)],
    }
    rows = []
    for source in range(6):
        for i in range(150):
            rows.append((len(rows), " ".join(plain()), "en", f"s{source}", "good"))
    # In the last source a fifth of the documents are noise of each kind in turn.
    for i in range(40):
        kind = list(bad)[i % len(bad)]
        rows.append((len(rows), " ".join(bad[kind]()), "en", "s5", kind))
    for i in range(8):
        line = " ".join(plain(60))
        rows.append((len(rows), "\n".join([line, *[" ".join(plain(2))] * 40]), "en", f"s{i % 6}", "dup_lines"))
    judged = quality.judge(spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, lang string, source string")).collect()
    verdict = {x["doc_id"]: (x["base_failed"], x["kept"]) for x in judged}
    for kind in (*bad, "dup_lines"):
        own = [verdict[x[0]] for x in rows if x[4] == kind]
        assert own and not any(kept for _, kept in own), kind
    good = [verdict[x[0]][1] for x in rows if x[4] == "good"]
    assert sum(good) >= 0.99 * len(good)


def test_sketch_bins(spark):
    values = [0, 1, 127, 128, 129, 130, 255, 256, 1000, 123456]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.sketch_bin(F.col("v"))).collect()]
    assert got[:3] == [0, 1, 127] and all(g <= v < g * 65 / 64 + 1 for g, v in zip(got, values, strict=True))


def test_toxicity_learns(spark):
    r = random.Random(4)
    clean = [f"{a}{b}" for a in ("ra", "se", "lo", "mi", "tu") for b in ("n", "st", "r", "tt", "k")]
    rows, labels = [], []
    for i in range(500):
        words = [r.choice(clean) for _ in range(60)]
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            words[r.randrange(60)] = r.choice(("vilest,", "Wretch", "fiend."))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert sum((got[i]["toxic_score"] >= 0.5) == bool(y) for i, y in labels) >= 480
    assert got[900]["toxic_score"] == got[901]["toxic_score"] < 0.5
    spans = got[0]["toxic_spans"]
    assert spans and rows[0][1][spans[0]["start"] : spans[0]["end"]]
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")).prior == 0.0


def test_forward_backward_matches_enumeration():
    r = np.random.default_rng(0)
    e, moves = r.normal(size=6), tuple(r.normal(size=4))
    total, by = 0.0, np.zeros(6)
    for code in range(64):
        y = [(code >> i) & 1 for i in range(6)]
        w = np.exp(sum(e[i] * y[i] for i in range(6)) + sum(moves[2 * a + b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        by += w * np.array(y)
    assert np.allclose(toxicity.marginals([e, np.empty(0), e[:1]], moves)[0], by / total)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>Menu</nav><div class='cookie-notice'><div>We</div> use</div><article><header><h1>A &amp; B</h1></header><p>One<br>two  three<p>Four<ul><li>five</ul><section class=comments><p>nice</p></section><script>x='</p>'</script></article><footer>F</footer>"
    rows = [(1, "http://h.com/a", page), (2, None, None), (3, "http://h.com/b", ""), (3, "http://h.com/b", "<p>plain")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "A & B\n\nOne two three\n\nFour\n\nfive", 32), (2, "", 0), (3, "", 0), (3, "plain", 5)]


def test_html_keeps_the_body_beside_a_small_article():
    card = "<article class='teaser'><h3>Read next</h3><p>A short card.</p></article>"
    body = "".join(f"<div><p>Sentence {i} of the page's own body, in plain elements.</p></div>" for i in range(20))
    got = [t for _, t in html.blocks(f"<body><div>{card}{body}</div><nav>menu</nav></body>")]
    assert len(got) == 22 and got[2].startswith("Sentence 0") and "menu" not in got
    assert [t for _, t in html.blocks(f"<body><main>{card}{body}</main><div>outside of it</div></body>")] == got
    # An article that is the page's text stands alone.
    assert [t for _, t in html.blocks(f"<body><article>{body}</article><div>A line beside it.</div></body>")] == got[2:]
    assert html.blocks("<article></article><p>x</p>") == [(0, "x")] and html.blocks("<article>a</article>") == [(1, "a")]


def test_html_repeated_runs():
    notice = "Sign in to read more stories like this one"
    pages = [[(0, notice), (0, f"Story number {i} tells about the matter of {i * 7} things and of others {i}"), (0, "short foot")] for i in range(12)]
    gone = html.repeated_blocks(pages)
    assert all(g == [True, False, True] for g in gone)


def test_html_of_large_hosts_does_not_depend_on_chunks(spark, monkeypatch):
    r = random.Random(3)
    story = lambda n=9: " ".join(r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(n))
    notice, five, quote = "Sign in to read more stories like this one", "one two three four five", "a passage that every article of this host holds in full"
    rows = []
    for i in range(60):
        kept = [story(), story(3)] + ([notice] if i % 6 == 0 else []) + ([five] if i % 12 == 1 else [story() + " " + five] if i % 12 == 2 else [])
        rows.append((i, f"http://large.com/{i}", "".join(f"<p>{k}</p>" for k in kept)))
        rows.append((100 + i, f"http://main.com/{i}", f"<article><p>{story(20)}</p><p>{quote}</p></article>"))
    rows += [rows[6], (None, "http://large.com/x", None), (200, None, f"<p>{notice}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: sorted((x["page_id"] or -1, x["text"]) for x in html.extract(pages).collect())
    whole = texts()
    assert sum(notice in t for _, t in whole) == 1 and not any(quote in t for _, t in whole)
    assert sum(five in t.split("\n\n") for _, t in whole) == 0
    monkeypatch.setattr(html, "CHUNK_CHARS", 300)  # two or three pages a chunk
    assert texts() == whole


def test_html_asks_for_a_fixed_number_of_pages_on_large_hosts():
    pages = [[(0, f"story {i} of {i + 5000} and {i * 3 + 10**6} too")] + [(0, "Notice of one section of this very large host")] * (i % 12 == 0) for i in range(2400)]
    gone = html.repeated_blocks(pages)
    assert all(g[1:] == [True] * (len(g) - 1) and not g[0] for g in gone)


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,")), (2, "text\nReleased under the MIT LICENCE!\nmore"), (3, None), (4, ""), (5, "mit"), (2, "Licensed under CC BY-NC 4.0.")]
    got = {(r["doc_id"], r["unit"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (1, "text", "MIT") in got and (2, "line", "MIT") in got and (2, "text", "CC-BY-NC-4.0") in got and not {g for g in got if g[0] > 2}


def test_license_texts_whole_and_among_other_text(spark):
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
   copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    third = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
    texts = {"BSD-2-Clause": bsd % "", "BSD-3-Clause": bsd % third, "MIT": licenses._MIT, "Zlib": licenses._ZLIB, "Unlicense": licenses._UNLICENSE, "Apache-2.0": licenses._APACHE_HEADER, "GPL-3.0-or-later": licenses._GPL_NOTICE}
    rows = [(i, f"Copyright (c) 2020 Someone\n\n{t}") for i, t in enumerate(texts.values())]
    rows += [(100 + i, f"A program.\n\nIts terms:\n\n{t}\n\nAnd more text after it.") for i, t in enumerate(texts.values())]
    rows += [(200, licenses._MIT.rsplit("\n\n", 1)[0] + "\n\nother terms"), (201, licenses._MIT.split("\n\n")[0])]
    got = {(r["doc_id"], r["unit"], r["position"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(texts):
        assert (i, "text", 0, name) in got and (100 + i, "section", 2, name) in got
    assert not {g for g in got if g[0] >= 200}
    assert all(name == list(texts)[i % 100] for i, _, _, name in got)


def test_long_license_texts(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all(os.path.exists(f"{folder}/{n}") for n in names):
        pytest.skip("no licence texts on this machine")
    rows = [(i + 100 * k, f"{'Before it.' + chr(10) * 2 if k else ''}{open(f'{folder}/{n}').read()}{chr(10) * 2 + 'After it.' if k else ''}") for k in (0, 1) for i, n in enumerate(names)]
    got = {(r["doc_id"], r["unit"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(names.values()):
        assert (i, "text", name) in got and (100 + i, "section", name) in got


def test_urls(spark):
    rows = [(1, "HTTP://WWW.Example.com/en/x?q", None), (2, "https://a.example.com/en/", ""), (3, "http://x.net/es/a#b", "<a href='http://bad.org/'>"), (4, None, None), (5, "no url", None), (6, "http://bad.org/", "<a href=//x.net/es/>"), (7, "http://good.org", '<a href="https://x.com/">'), (8, "x://net/fr/", None), (9, "http://y.com", "<a href='http://good.org'>")]
    got = {r["page_id"]: r for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["rule"] for i in (1, 2, 3, 8)] == ["www.example.com/en/", "example.com/en/", "net/es/", "net/fr/"]
    assert (got[1]["host"], got[1]["path"]) == ("www.example.com", "/en/x") and (got[4]["host"], got[4]["path"], got[4]["verdict"]) == ("", "", "allow")
    assert got[6]["verdict"] == "block" and got[7]["verdict"] == "allow"


def test_url_ranks_match_brute_force(spark, monkeypatch):
    r = random.Random(11)
    hosts = [f"h{i}.org" for i in range(20)] + ["com", "a.com", "b.a.com", "c.net", "d.net"]
    rows = []
    for i in range(150):
        host = hosts[min(int(r.expovariate(0.2)), len(hosts) - 1)] if i else "h0.org"
        links = r.sample(hosts + ["far.edge"], r.randrange(4))
        rows.append((i, f"http://{host}/{r.choice(['es/', 'en/'])}{i}", " ".join(f"<a href='http://{h}/'>x</a>" for h in links)))
    weights, share, pages, good, bad = {}, {}, {}, {}, {}
    for _, url, page in rows:
        host, path = url[7:].split("/", 1)
        pages[host] = pages.get(host, 0) + 1
        good[host] = good.get(host, 0) + host.endswith("com")
        bad[host] = bad.get(host, 0) + (host.endswith(".net") and path.startswith("es/"))
        for other in {x.split("/")[0] for x in page.split("http://")[1:]} - {host}:
            weights[host, other] = weights.get((host, other), 0) + 1
    for host in pages:
        parts = host.split(".")
        if up := next((u for i in range(1, len(parts)) if (u := ".".join(parts[i:])) in pages), None):
            for pair in ((host, up), (up, host)):
                weights[pair] = weights.get(pair, 0) + pages[host]
    names = sorted({h for pair in weights for h in pair} | set(pages))
    at = {h: i for i, h in enumerate(names)}

    def walk(seeds, pairs):
        m = np.zeros((len(names), len(names)))
        for (src, dst), n in pairs.items():
            m[at[dst], at[src]] = n
        m /= np.maximum(m.sum(0), 1e-300)
        s = np.array([float(seeds.get(h, 0)) for h in names])
        return np.linalg.solve(np.eye(len(names)) - 0.85 * m, 0.15 * s)

    back = {(dst, src): n for (src, dst), n in weights.items()}
    with np.errstate(invalid="ignore"):
        trust, distrust = (np.nan_to_num(walk(s, w) / walk(pages, w)) for s, w in ((good, weights), (bad, back)))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert len(weights) > 60
    for bound in (urlgraph.BROADCAST_HOSTS, 0):
        monkeypatch.setattr(urlgraph, "BROADCAST_HOSTS", bound)
        for x in urlgraph.judge(table, tolerance=1e-7).collect():
            i = at[x["host"]]
            assert abs(x["trust"] - trust[i]) < 1e-4 and abs(x["distrust"] - distrust[i]) < 1e-4
            if x["rule"] is None and abs(distrust[i] - 0.5) > 1e-3 and abs(distrust[i] - trust[i]) > 1e-3:
                assert x["verdict"] == ("block" if distrust[i] >= 0.5 and distrust[i] > trust[i] else "allow")


def test_html_covers_what_repeated_substrings_of_any_length_cover():
    r = random.Random(5)
    passages = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (3, 6, 7, 15, 40)]
    pages = []
    for i in range(12):
        own = []
        for _ in range(r.randrange(1, 6)):
            parts = [r.choice(passages) if r.random() < 0.6 else " ".join(r.choice(WORDS[:6]) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 3))]
            own.append((0, " ".join(parts)))
        pages.append(own)
    held = {}
    for p, own in enumerate(pages):
        for _, text in own:
            w = text.split()
            for a in range(len(w)):
                for b in range(a + 1, len(w) + 1):
                    if b - a >= html.RUN or (a, b) == (0, len(w)):
                        # A block shorter than a run is repeated only as a whole block.
                        held.setdefault((tuple(w[a:b]), b - a < html.RUN), set()).add(p)
    want = []
    for own in pages:
        want.append([])
        for _, text in own:
            w = text.split()
            covered = set()
            for a in range(len(w)):
                for b in range(a + 1, len(w) + 1):
                    if len(held.get((tuple(w[a:b]), b - a < html.RUN), ())) >= html.least_pages(len(pages), 0):
                        covered |= set(range(a, b)) if b - a >= html.RUN or (a, b) == (0, len(w)) else set()
            want[-1].append(len(covered) == len(w))
    assert html.repeated_blocks(pages) == want
    assert 5 < sum(map(sum, want)) < sum(map(len, want)) - 5


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for made in (quality.judge(empty), spm.digests(empty), pii.find_spans(empty), linededup.line_report(empty), toxicity.score(empty, toxicity.train(empty, labels)), html.extract(pages), licenses.scan(empty), decontam.find_items(empty, bench), urlgraph.judge(pages), ngramjoin.jaccard_components(empty)):
        assert made.count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    out = corpus_pipeline.run(spark, small)
    assert 0 < out.count() <= n
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    clean = [f"{a}{b}" for a in ("ra", "se", "lo", "mi", "tu", "ke") for b in ("n", "st", "r", "tt", "k", "lm")]
    story = lambda n=70: [r.choice(clean) + str(r.randrange(300)) for _ in range(n)]
    docs, labels, items = [], [], [(0, " ".join(story(12))), (1, "too few words"), (2, None)]
    for i in range(160):
        words = story()
        if toxic := i % 4 == 0:
            for _ in range(5):
                words[r.randrange(70)] = r.choice(("vilest,", "Wretch", "fiend."))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    base = [d[1] for d in docs if d[0] % 4]
    docs += [(200, base[3]), (201, base[3].upper()), (202, base[4] + " tail of it"), (203, " ".join(base[5].split()[:35] + ["new"] + base[5].split()[35:]))]
    docs += [(300 + k, f"{' '.join(story())}\n{LINE}\n{' '.join(story(3))}") for k in range(6)]
    docs += [(400, " ".join(story(20)) + " " + items[0][1] + ", " + " ".join(story(20))), (401, " ".join(items[0][1].split()[:5])), (402, "x Too few WORDS y " + " ".join(story(60)))]
    docs += [(500, None), (501, ""), (None, base[6])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, tied string"
    rows = [(i, t, "en", None, None if t is None else len(t), "d", "t") for i, t in docs]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    where = str(tmp_path)
    now = spark.read.parquet(f"{where}/documents.parquet")
    out = lambda df: sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=str)

    kept = stages["toxicity"](spark, now, where).cache()
    want = sorted(((i, t) for i, t in docs if i is None or i >= 160 or i % 4), key=str)
    assert out(kept) == want and kept.columns == now.columns

    kept, before = stages["line_dedup"](spark, kept, where).cache(), want
    want = sorted(((i, t if not t or LINE not in t or i == 305 else "\n".join(x for x in t.split("\n") if x != LINE)) for i, t in before), key=str)
    assert out(kept) == want and kept.where("length(text) <> n_chars").count() == 0

    kept, before = stages["ngram_jaccard_join"](spark, kept, where).cache(), want
    sets, find = jaccard([x for x in before if x[0] is not None], 5, 80)
    gone = {i for i, s in sets if s and find(i) != i}
    want = [x for x in before if x[0] not in gone]
    assert out(kept) == want and gone == {200, 201, 202, 203}

    kept, before = stages["benchmark_decontamination"](spark, kept, where).cache(), want
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w, n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    leaks = set()
    for i, t in before:
        for _, item in items:
            w = split(item)
            own = shingles(w, min(5, len(w))) if w else set()
            if own and len(own & shingles(split(t), min(5, len(w)))) * 100 >= 80 * len(own) and i is not None:
                leaks.add(i)
    want = [x for x in before if x[0] not in leaks]
    assert out(kept) == want and leaks == {400, 402}

    lib = sentencepiece.SentencePieceProcessor(model_file=spm.model_path())
    got = {x["doc_id"]: x["ids_sha256"] for x in stages["sentencepiece"](spark, kept, where).collect()}
    for i, t in want:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[i] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    whole = {x["doc_id"]: x["ids_sha256"] for x in corpus_pipeline.run(spark, where).collect()}
    assert whole == got
    empty = now.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, where).count() == 0
