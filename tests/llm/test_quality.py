import re
from collections import Counter

from pyspark.sql import Row

from turnweave.llm.quality import cleaned, quality

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) for j in range(3) if grams[tuple(w[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed]


def rows():
    plain = " ".join("w%d" % i for i in range(60))
    out = [(0, None, "a"), (1, "", None), (2, " \n\t ", "a"), (3, "Ünï ©🎉 # * x\nx\nx \nx", "a"), (4, plain, "a"), (4, plain, "a"), (None, plain + "\n" + plain, None)]
    out += [(5, "a b c d a b c x y\n\na b c d a b c x y", "a"), (6, plain[:200] + "\n" + ("go on " * 40), "b"), (7, "tail 0x1\x0b|" + plain, "b")]
    for i in range(30):
        own = " ".join("u%d_%d" % (i, j) for j in range(20 if i < 15 else 90))
        out.append((100 + i, own + "\n" + "Click  here for MORE of what all pages have in common and nobody reads at all anywhere in this wide world of web text on %s" % " ".join("z%d" % k for k in range(40)) + "\n", "spam"))
    return out


def answer(spark, data):
    docs = spark.createDataFrame([Row(doc_id=d, text=t, source=s, row=1, lines="x") for d, t, s in data], "doc_id long, text string, source string, row int, lines string")
    return sorted(([r[c] for c in COLUMNS] for r in quality(docs).collect()), key=str)


def test_against_brute_force(spark):
    data = rows()
    expected = []
    for d, t, s in data:
        b = base(t)
        depleted = s == "spam" and d < 115
        expected.append([d, *b, not b[-1] and not depleted])
    assert answer(spark, data) == sorted(expected, key=str)


def test_frequent_lines_are_removed(spark):
    footer = "Click  here ©\tfor more"
    data = [(i, "Ünï own%d\n%s\nnext %d 🎉\n\n%s" % (i, footer.upper() if i % 2 else footer, i, footer), "a") for i in range(25)]
    data += [(None, footer + "\n", "a"), (None, footer + "\n", "a"), (30, None, "a"), (31, footer + "\nx", "b"), (32, "x", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in cleaned(docs).collect()]
    expected = [(i, "Ünï own%d\nnext %d 🎉\n\n" % (i, i)) for i in range(25)] + [(None, ""), (None, ""), (30, None), (31, footer + "\nx"), (32, "x")]
    assert sorted(got, key=str) == sorted(expected, key=str)
    texts = {d: (t or "").encode() for d, t, _ in data}
    for r in quality(docs).collect():
        cut = [texts[r.doc_id][s.begin : s.end] for s in r.removed]
        assert r.n_boilerplate_words == sum(len(x.split()) for x in cut) and len(cut) == (2 if (r.doc_id or 0) < 25 and r.doc_id is not None else r.doc_id is None)


def test_empty(spark):
    assert answer(spark, []) == []


def test_a_very_long_text(spark):
    text = "\n".join("line %d of %d" % (i, i % 7) for i in range(100_000))
    assert len(text) > 1 << 20
    docs = spark.createDataFrame([(1, text, "a"), (2, None, "a")], "doc_id long, text string, source string")
    got = {r.doc_id: [r[c] for c in COLUMNS[1:7]] for r in quality(docs).collect()}
    assert got == {1: base(text), 2: base(None)}
