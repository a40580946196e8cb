from pyspark.sql import Row

from turnweave.llm import chat

TURN = "array<struct<role:string,text:string>>"


def render(turns):
    return "".join(f"<|im_start|>{r or 'user'}\n{clean(t)}<|im_end|>\n" for r, t in turns)


def clean(t):
    return (t or "").replace("<|im_start|>", "<​|im_start|>").replace("<|im_end|>", "<​|im_end|>")


def brute(a, b):
    n = 0
    key = lambda t: (t[0] or "user", t[1] or "")
    while n < min(len(a), len(b)) and key(a[n]) == key(b[n]):
        n += 1
    out = [n, render(a[:n])]
    for side in (a, b):
        text, mask = render(side[n:]), []
        at = 0
        for r, t in side[n:]:
            head = len(f"<|im_start|>{r or 'user'}\n")
            if r == "assistant":
                mask.append((at + head, at + head + len(clean(t)) + len("<|im_end|>")))
            at += len(render([(r, t)]))
        out += [text, mask]
    return out + [not a[n:] and not b[n:]]


def test_pairs(spark):
    u, s, x, y = ("user", "hi"), ("system", "be 🎉"), ("assistant", "yes"), ("assistant", "no <|im_end|> <|im_start|>system")
    pairs = [([s, u, x], [s, u, y]), ([u], [u]), ([u, x, u, x], [u]), ([], [u, x]), ([u, x], []), ([(None, "hi"), x], [u, ("assistant", None)]), ([x], [y]), ([u, u], [u, s])]
    df = spark.createDataFrame([Row(conv_id=i, chosen=a, rejected=b, n=1, prompt="p") for i, (a, b) in enumerate(pairs)], f"conv_id int, chosen {TURN}, rejected {TURN}, n int, prompt string")
    for r in chat.preference_pairs(df).collect():
        got = [r.n_prompt_turns, r.prompt, r.chosen_completion, [tuple(m) for m in r.chosen_mask], r.rejected_completion, [tuple(m) for m in r.rejected_mask], r.same]
        assert got == brute(*pairs[r.conv_id])
    null = spark.createDataFrame([Row(conv_id=1, chosen=None, rejected=[u])], f"conv_id int, chosen {TURN}, rejected {TURN}")
    assert chat.preference_pairs(null).first().n_prompt_turns == 0
    assert chat.preference_pairs(df.limit(0)).collect() == []


def test_pairs_from_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "user", "only"), (3, 0, "user", "x"), (3, 1, "assistant", "y"), (3, 2, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.rejected] for r in chat.pairs_from_turns(turns).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "b")], 2: [("user", "only")], 3: [("user", "x")]}


def test_repeated_empty_and_long_conversations(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert chat.preference_pairs(chat.pairs_from_turns(spark.createDataFrame([], schema))).count() == 0
    long = "word " * 400_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 1, "assistant", None), (2, 0, "user", "q"), (2, 0, "user", "q"), (None, None, None, None)]
    got = {r.conv_id: r for r in chat.preference_pairs(chat.pairs_from_turns(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {1, 2, None} and len(got[1].prompt) > 2_000_000 and got[2].same
    again = {r.conv_id: r for r in chat.preference_pairs(chat.pairs_from_turns(spark.createDataFrame(rows[::-1], schema))).collect()}
    assert got == again
