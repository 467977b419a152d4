import hashlib
import random

import pytest

from voxloom.llm import ordersketch

SCHEMA = "doc_id long, text string, fingerprint string, t string, head string, w string, place string"


def story(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("banker lomi nust trell kova ste miru pank".split()) + str(r.randrange(40)) for _ in range(n))


def rows():
    texts = [story(1, 300), story(1, 300), story(2, 300), " ".join(story(1, 300).split()[:290] + ["new"]), None, "", " \n\t ", "one", "two words", "été 中文 😀 ok", "a " * 5000, story(5, 9000)]
    out = [(i, t, "x", "y", "z", "q", "p") for i, t in enumerate(texts)]
    return [*out, out[2], (3, "other text of the same id", *out[0][2:]), (None, story(7, 60), *out[0][2:]), (None, None, *out[0][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def elements(text, k):
    """The numbered k-mers of a text, in order."""
    w = (text or "").strip(" \t\n\x0b\f\r").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x] or [""]
    seen, out = {}, []
    for i in range(max(1, len(w) - k + 1)):
        gram = tuple(w[i : i + k])
        out.append((gram, seen.get(gram, 0)))
        seen[gram] = seen.get(gram, 0) + 1
    return out


def true_likeness(a, b, k, length, draws=4000):
    """Share of random orders under which both texts give the same tuple."""
    r, same = random.Random(3), 0
    every = sorted({*a, *b})
    for _ in range(draws):
        rank = {e: r.random() for e in every}
        pick = lambda xs: tuple(sorted(sorted(range(len(xs)), key=lambda i: rank[xs[i]])[:length]))
        same += [a[i] for i in pick(a)] == [b[i] for i in pick(b)]
    return same / draws


def test_contract(docs):
    got = ordersketch.edited_report(docs).collect()
    assert len(got) == docs.count()
    by_id = {}
    for r in rows():
        by_id.setdefault(r[0], []).append(r[1] or "")
    ids = sorted((i for i in by_id if i is not None), reverse=True)
    follow = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    for g in got:
        texts, heads = by_id[g["doc_id"]], by_id[follow[g["doc_id"]]] if g["doc_id"] is not None else [""]
        wanted = {(len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + h[: len(t) // 2]).encode()).hexdigest()) for t in texts for h in heads}
        assert (g["n_chars"], g["edited_sha256"]) in wanted
        assert len(g["fingerprint"]) == len(g["edited_fingerprint"]) == 8 * ordersketch.COUNT
        parts = [[g[c][i : i + 8] for i in range(0, len(g[c]), 8)] for c in ("fingerprint", "edited_fingerprint")]
        assert g["near_edited"] == sum(x == y for x, y in zip(*parts, strict=True)) / ordersketch.COUNT
    of = {g["doc_id"]: g for g in got}
    assert of[0]["fingerprint"] == of[1]["fingerprint"] != of[2]["fingerprint"] and of[1]["near_next"] == 1.0
    assert of[4]["fingerprint"] == of[5]["fingerprint"] == of[6]["fingerprint"] and of[5]["near_edited"] == 1.0


def test_likeness_estimates_order_min_hash(spark):
    words = story(11, 120).split()
    moved = words[60:] + words[:60]
    cases = [(words, words), (words, [*words[:50], "x", *words[51:]]), (words, moved), (words, words[::-1]), (words * 2, words), (words[:3], words[:3])]
    count = 1024
    frame = spark.createDataFrame([(i, " ".join(a), "\n".join(b)) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    made = ordersketch.with_fingerprint(ordersketch.with_fingerprint(frame, "a", "x", count=count), "b", "y", count=count)
    got = {r["i"]: r["near"] for r in made.select("i", ordersketch.likeness("x", "y").alias("near")).collect()}
    for i, (a, b) in enumerate(cases):
        want = true_likeness(elements(" ".join(a), 5), elements(" ".join(b), 5), 5, 2)
        assert abs(got[i] - want) < 0.06
    # Moved parts keep their words' set and lose their order.
    assert got[2] < 0.75 < got[0] == 1.0


def test_repeats_are_numbered(spark):
    frame = spark.createDataFrame([(0, "a b c d e " * 3), (1, "a b c d e " * 4)], "i int, text string")
    one, two = (r["fingerprint"] for r in ordersketch.fingerprints(frame).orderBy("i").collect())
    assert one != two


def test_own_columns_stay(docs):
    out = ordersketch.fingerprints(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_empty(spark):
    assert ordersketch.edited_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_leaves_the_jvm(docs):
    plan = ordersketch.edited_report(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
