import hashlib
import random
import re

from pyspark.sql import Row

from turnweave.llm.decontaminate import contaminated

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(doc_id), len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def answer(spark, docs, items, **options):
    d = spark.createDataFrame([Row(doc_id=i, text=t, item="x", words=1, k1="k") for i, t in docs], "doc_id long, text string, item string, words int, k1 string")
    b = spark.createDataFrame([Row(item_id=i, text=t, length=1, items="y") for i, t in items], "item_id long, text string, length int, items string")
    got = contaminated(d, b, **options).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)


def tables():
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choices(["ab", "cde", "f1", "été", "g", "hij", "k2", "lm"], k=n))
    items = [(i, prose(rng.randrange(13, 40))) for i in range(8)] + [(20, "just four short words"), (21, "solo"), (22, None), (23, " . "), (24, "a a a a a a a a a a a a a a a")]
    items.append((25, items[0][1]))
    docs = [(i, prose(rng.randrange(0, 80))) for i in range(20)]
    for i in range(20, 40):
        _, text = rng.choice(items[:8])
        w = text.split()
        a = rng.randrange(len(w))
        docs.append((i, prose(rng.randrange(60)) + "\n" + ", ".join(w[a : a + rng.randrange(8, 30)]).upper() + "! " + prose(rng.randrange(400))))
    docs += [(50, None), (51, ""), (52, "...!"), (53, items[0][1]), (53, items[0][1]), (None, "x just FOUR short-words y"), (54, "solo " * 3), (55, "a " * 200), (56, "b " + "a " * 12), (57, items[1][1] + " " + items[1][1])]
    return docs, items


def test_against_all_windows(spark):
    docs, items = tables()
    assert answer(spark, docs, items) == brute(docs, items)


def test_without_broadcasts(spark):
    docs, items = tables()
    assert answer(spark, docs, items, max_broadcast=0) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = tables()
    assert answer(spark, docs, []) == brute(docs, [])
    assert answer(spark, [], items) == []


def test_a_very_long_text(spark):
    item = " ".join("w%d" % i for i in range(20))
    docs = spark.createDataFrame([(1, "b " * 300_000 + item), (2, "b " * 12)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contaminated(docs, items).collect()}
    assert got == {1: (300_020, 20, 1, False), 2: (12, 0, 0, False)}
