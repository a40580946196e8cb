"""The whole compression against a plain Python version, over a whole table."""

import hashlib
import json
import math
import re
import statistics
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from turnweave.plans import queries

FOLDER = "/root/testdata/sf0.001"


def near(x, digits=6):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def tokens(text):
    return re.findall("[a-z0-9]+", text.lower())


def vector(text):
    out = [0.0] * 64
    for w in tokens(text):
        out[int(hashlib.md5(w.encode()).hexdigest(), 16) % 64] += 1
    return out


def length(v):
    return math.sqrt(sum(x * x for x in v)) + 1e-12


def scaled(values):
    low, high = min(values), max(values)
    return [0.5 if high - low < 1e-12 else (x - low) / (high - low) for x in values]


def relevance(texts, query):
    docs, asked = [tokens(t) for t in texts], Counter(tokens(query))
    df = Counter(w for d in docs for w in set(d))
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw) if raw else 0.0
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    lexical = [near(sum(idf[w] * asked[w] * k * 2.5 / (k + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w, k in Counter(d).items() if asked[w])) for d in docs]
    q = vector(query)
    cosine = [near(sum(a * b for a, b in zip(v, q)) / (length(v) * length(q))) for v in map(vector, texts)]
    return [near(0.6 * c + 0.4 * b) for c, b in zip(scaled(cosine), scaled(lexical))]


def sentences(text):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]


def selected(text, query, target):
    parts = sentences(text)
    if not parts:
        return None
    score, spent, kept = relevance(parts, query), 0, []
    for i in sorted(range(len(parts)), key=lambda i: (-score[i], i)):
        spent += len(parts[i].split())
        if spent > target:
            break
        kept.append(i)
    return " ".join(parts[i] for i in sorted(kept)) if kept else None


def bigrams(corpus):
    pair = Counter()
    for text in corpus:
        w = text.lower().split()
        pair.update(zip(w, w[1:]))
    head = Counter()
    for (v, _), k in pair.items():
        head[v] += k
    return pair, head, max(1, len({w for _, w in pair}))


def pruned(text, fraction, model):
    pair, head, size = model
    words = text.split()
    low = [w.lower() for w in words]
    own = [near(-math.log((pair[v, w] + 0.1) / (head[v] + 0.1 * size))) for v, w in zip(low, low[1:])]
    info = [statistics.median(own) if own else 0.0, *own]
    keep = max(1, round(len(words) * fraction))
    best = sorted(sorted(range(len(words)), key=lambda i: (-info[i], i))[:keep])
    return " ".join(words[i] for i in best)


def condensed(text, query, target, model):
    if target <= 0 or not text.split():
        return ""
    found = selected(text, query, max(1, int(target * 1.5)))
    text = text if found is None else found
    size = len(text.split())
    if found is not None and size <= target:
        return text
    return pruned(text, min(1.0, max(0.01, target / size)), model) if size else ""


def compressed(turns, query, model, fraction=0.5, theta=0.85, recent_n=2):
    """turns: (id, role, content) in order."""
    size = {i: len(c.split()) for i, _, c in turns}
    kept, survivor = [], {}
    for i, _, c in turns:
        v = vector(c)
        unit = [x / length(v) for x in v]
        survivor[i] = next((j for j, u in kept if near(sum(a * b for a, b in zip(u, unit))) >= theta), i)
        if survivor[i] == i:
            kept.append((i, unit))
    alive = [t for t in turns if survivor[t[0]] == t[0]]
    score = dict(zip((t[0] for t in alive), relevance([t[2] for t in alive], query)))
    budget = left = int(max(1, int(sum(size.values()) * fraction)) * 0.9)
    recent, spent = set(), 0
    for i, _, _ in list(reversed(alive))[:recent_n]:
        spent += size[i]
        if spent <= budget * 0.5:
            recent.add(i)
    tier = {}
    for i in sorted(score, key=lambda i: (i not in recent, -score[i], i)):
        short = math.ceil(size[i] * 0.3)
        tier[i], cost = ("KEEP_RECENT", size[i]) if i in recent else ("KEEP_FULL", size[i]) if left >= size[i] else ("COMPRESS", short) if left >= short else ("DROP", 0)
        left -= cost
    messages, dropped = [], []
    for i, role, content in alive:
        out = content if tier[i].startswith("KEEP") else condensed(content, query, max(1, math.ceil(size[i] * 0.3)), model) if tier[i] == "COMPRESS" else None
        if out is None or (tier[i] == "COMPRESS" and not out):
            dropped.append(i)
        else:
            messages.append((role, out))
    groups = defaultdict(list)
    for i, s in survivor.items():
        groups[s].append(i)
    before, after = sum(size[t[0]] for t in alive), sum(len(m.split()) for _, m in messages)
    return messages, before, after, tier, dropped, sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.fixture(scope="module")
def table(spark):
    rows = defaultdict(list)
    for r in queries.turns(spark, FOLDER).orderBy("conv_id", "turn_id").collect():
        rows[r.conv_id].append((r.turn_id, r.role, r.content))
    return rows


@pytest.fixture(scope="module")
def model(table):
    return bigrams(c for t in table.values() for _, _, c in t[:-1])


def test_compress_pipeline(spark, table, model):
    got = {r.conv_id: r for r in queries.compress_pipeline(spark, FOLDER).collect()}
    assert set(got) == {c for c, t in table.items() if len(t) > 1} and len(got) >= 10
    tiers = Counter()
    for c, r in got.items():
        messages, before, after, tier, dropped, merged = compressed(table[c][:-1], table[c][-1][2], model)
        tiers.update(tier.values())
        assert r.messages == "\n".join(f"{role}: {m}" for role, m in messages)
        assert (r.original_tokens, r.compressed_tokens, r.compression_ratio) == (before, after, near(after / before))
        assert r.tiers == ",".join(f"{i}={tier[i]}" for i in sorted(tier)) and r.dropped == ",".join(map(str, dropped))
        assert json.loads(r.merged_groups) == merged
    assert len(tiers) == 4  # all of them are met


def test_adapter_batch(spark, table):
    plain = {c: [t for t in turns if t[1] != "system"] for c, turns in table.items()}
    model = bigrams(c for t in plain.values() for _, _, c in t[:-1])
    for r in queries.adapter_batch(spark, FOLDER).collect():
        turns = plain[r.conv_id]
        messages = compressed(turns[:-1], turns[-1][2], model, theta=0.92)[0] if len(turns) > 1 else []
        assert (r.n_messages, r.latest) == (len(messages) + 1, turns[-1][2])


def test_sentences_and_condensing(spark, table, model):
    asked = {(c, i): (text, t[-1][2]) for c, t in table.items() for i, _, text in t[:-1]}
    got = {(r.conv_id, r.turn_id): r.selected for r in queries.extractive_select(spark, FOLDER).collect()}
    want = {k: selected(text, q, max(1, math.ceil(len(text.split()) * 0.45))) for k, (text, q) in asked.items()}
    assert got == {k: v for k, v in want.items() if v is not None}
    got = {(r.conv_id, r.turn_id): r.compressed for r in queries.compress_turns(spark, FOLDER).collect()}
    assert got == {k: condensed(text, q, max(1, math.ceil(len(text.split()) * 0.3)), model) for k, (text, q) in asked.items()}


def test_eval_pipeline(spark, table, model):
    summary = queries.eval_pipeline(spark, FOLDER).where("category = 'ALL'").orderBy("budget_frac").collect()
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    for r in summary:
        hits = []
        for turns in table.values():
            held = turns[:-1]
            if not held or held[-1][0] == 0:
                continue
            gold = " ".join(next(c for i, _, c in held if i == held[-1][0] // 2).split()[:3])
            messages = compressed(held, turns[-1][2], model, r.budget_frac, 0.92)[0]
            hits.append(norm(gold) in norm("\n".join(m for _, m in messages)))
        assert r.n_cases == len(hits) and r.answer_present_rate == round(sum(hits) / len(hits), 4)


def test_validation_queries(spark, table):
    found = queries.validation_findings(spark, FOLDER).collect()
    assert len(found) == sum(len(t) > 1 for t in table.values())
    for r in found:
        turns = table[int(r.case_id)]
        wrong = [i for i, role, _ in turns if role not in ("user", "assistant")]
        odd = [i for i, role, _ in turns if role in ("user", "assistant") and role != ("user", "assistant")[i % 2]]
        codes = r.errors.split(",") if r.errors else []
        assert (r.n_turns, codes.count("V9"), codes.count("V10")) == (len(turns), len(wrong), len(odd))
    total = queries.validation_summary(spark, FOLDER).first()
    assert total.n_cases == len(found) and total.n_errors == sum(len(r.errors.split(",")) for r in found if r.errors)
    assert total.n_usable == sum(not r.errors for r in found)
    assert queries.turns(spark, FOLDER).agg(F.count("*")).first()[0] == sum(map(len, table.values()))
