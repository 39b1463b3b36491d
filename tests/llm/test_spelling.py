import random
import re
import zlib

from barloom.llm import spelling

from .fixtures import frame, rows

LETTERS = "A-Za-z\u00c0-\u00ff"


def brute_words(data, least_letters, least_count, errors):
    counts = {}
    for r in data:
        for run in re.findall(f"[{LETTERS}]+", r[1] or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % errors == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_letters:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= least_count}


def one_edit(s, t):
    if len(s) > len(t):
        s, t = t, s
    if len(s) == len(t):
        return sum(a != b for a, b in zip(s, t)) == 1
    return len(t) == len(s) + 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(counts, ratio):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def misspelt(seed=1):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcdé") for _ in range(draw.randint(5, 11))) for _ in range(30)]
    base += ["same" * 3 + "".join(draw.choice("abc") for _ in range(4)) for _ in range(60)] + ["aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaa"]
    docs = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = draw.choice(base[: 1 + int(len(base) * draw.random() ** 2)])
            if draw.random() < 0.3:
                at = draw.randrange(len(w) + 1)
                w = draw.choice([w[:at] + draw.choice("abÀ") + w[at:], w[:at] + w[at + 1 :], w[:at] + "b" + w[at + 1 :]])
            words.append(w.upper() if draw.random() < 0.1 else w)
        docs.append((i if i % 17 else None, "-".join(words), *[None] * 7))
    return docs


def collected(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_equal_brute_force_however_buckets_are_cut(spark):
    data = misspelt()
    for errors, least, pairs in ((31, 7, 512), (3, 2, 1)):
        want = brute(brute_words(data, least, 2, errors), 10)
        assert any(w[1] != w[2] and w[1] for w in want) or errors != 31 or any(w[1] for w in want)
        got = spelling.variants(frame(spark, data), least_letters=least, errors=errors, pairs=pairs)
        assert got.count() == len(want) and collected(got) == want


def test_odd_rows_and_repeats(spark):
    data = rows() + [(900, "x" * 5000 + " " + "x" * 5001, *[None] * 7)] * 2
    assert collected(spelling.variants(frame(spark, data), least_letters=3, pairs=4)) == brute(brute_words(data, 3, 2, 31), 10)


def test_chain_of_forms(spark):
    text = " ".join(["abcdefg"] * 300 + ["abcdefh"] * 30 + ["abcdeih"] * 3 + ["abcjeih", "zzzzzzz"] * 2)
    got = {r.word: (r.form, r.root) for r in spelling.variants(frame(spark, [(1, text, *[None] * 7)]), errors=10**9).collect()}
    assert got["abcdefh"] == ("abcdefg", "abcdefg") and got["abcdeih"] == ("abcdefh", "abcdefg") and got["zzzzzzz"] == (None, "zzzzzzz")
    assert got["abcjeih"] == (None, "abcjeih")


def test_no_rows(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None, *[None] * 7), (2, "", *[None] * 7)])).count() == 0


def test_crowded_buckets_cost_no_pairs(spark):
    """Words that share a half but are not alike: rows met stay in proportion to the words."""
    from barloom.llm.stage import stage

    draw = random.Random(5)
    words = sorted({"prefixprefix" + "".join(draw.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(3000)})
    df = stage(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    assert spelling.near_pairs(df).count() == 0
    cut = spelling._halved(df.selectExpr("word", "n", "0 AS shift", "24 AS length", "0 AS a", "24 AS b"))
    assert cut.groupBy("key").count().agg({"count": "max"}).first()[0] == len(words)
    for _ in range(2):
        cut = spelling._halved(cut.drop("key"))
    assert cut.filter("b > 12").groupBy("key").count().agg({"count": "max"}).first()[0] <= 40
