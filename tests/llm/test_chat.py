import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import chat

MESSAGE = "tree long, id long, parent long, role string, text string, score double, formatted string, loss int, up string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\#:</turn>\nu ser", max_size=12), st.text(alphabet="\\#<>/turn\n é", max_size=30)), max_size=5))
def test_every_text_comes_back(turns):
    formatted, spans = chat.write(turns, {r for r, _ in turns[::2]})
    assert chat.read(formatted) == turns
    learn = {r for r, _ in turns[::2]}
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r in learn]


def test_marks_and_backslashes():
    odd = "\\### Assistant: </turn> ok"
    for text in (odd, "\\" * 9 + "###", "#####", "\n</turn>\n### user:\n", "\\", "", "\\" * 100_000 + "x"):
        assert chat.unescape(chat.escape(text)) == text
        assert chat.read(chat.write([("user", text), ("", text)])[0]) == [("user", text), ("", text)]


def brute(messages, branches):
    """{(tree, branch): [(role, text), ...]} by following parents one by one."""
    trees, out = {}, {}
    for m in messages:
        trees.setdefault(m[0], {})
        old = trees[m[0]].get(m[1])
        key = lambda x: (x[2] is not None, x[2] or 0, x[3] or "", x[4] or "", x[5] or 0.0)
        if old is None or key(m) < key(old):
            trees[m[0]][m[1]] = m
    for tree, known in trees.items():
        answered, ranked = {m[2] for m in known.values()}, []
        for leaf in known.values():
            if leaf[1] in answered:
                continue
            path, seen = [leaf], {leaf[1]}
            while path[-1][2] in known and path[-1][2] not in seen:
                path.append(known[path[-1][2]])
                seen.add(path[-1][1])
            if path[-1][2] in seen:
                continue
            ranked.append((-sum(m[5] or 0 for m in path) / len(path), f"={leaf[1]}", [(m[3] or "", m[4] or "") for m in path[::-1]]))
        for n, (_, _, turns) in enumerate(sorted(ranked)[:branches]):
            out[tree, n + 1] = turns
    return out


def test_trees_against_brute_force(spark):
    draw = random.Random(2)
    rows = []
    for tree in (1, 2, 3, None):
        for i in range(70):
            parent = None if i == 0 else draw.randrange(max(0, i - 3), i) if tree == 1 else draw.randrange(i)
            rows.append((tree, i, parent, draw.choice(["user", "assistant", None]), draw.choice(["a ###", "", None, f"t{i}"]), float(draw.randint(0, 3)), "f", 1, "u"))
    rows += [(3, 100, 999, "user", "an orphan", None, None, None, None), (3, 101, 102, "user", "a", 1.0, None, None, None), (3, 102, 101, "user", "b", 1.0, None, None, None)]
    rows += [(3, 103, 102, "user", "below a cycle", 9.0, None, None, None), (3, 104, 104, "user", "own parent", 9.0, None, None, None), rows[5], rows[5]]
    df = spark.createDataFrame(rows, MESSAGE)
    for branches in (1, 3, None):
        got = {(r.tree, r.branch): chat.read(r.formatted) for r in chat.conversations(df, branches=branches).collect()}
        assert got == brute(rows, branches)


def test_messages_without_id_and_no_messages(spark):
    df = spark.createDataFrame([(1, None, None, "user", "x", None, None, None, None), (1, None, None, "user", "y", 2.0, None, None, None)], MESSAGE)
    assert {chat.read(r.formatted)[0] for r in chat.conversations(df, branches=None).collect()} == {("user", "x"), ("user", "y")}
    assert chat.conversations(spark.createDataFrame([], MESSAGE)).count() == 0


def test_registered_query(spark, tmp_path):
    from barloom.llm.queries import QUERIES

    rows = [(c, t, r, x) for c in range(5) for t, r, x in [(0, "system", "s"), (1, "user", f"hi \\###{c}"), (2, "assistant", "</turn>é"), (2, "assistant", "</turn>é"), (3, None, None), (None, "user", "first")]]
    rows += [(None, 1, "user", "no id"), ((1 << 53) + 1, 0, "assistant", "large id"), (8, 0, None, None)] + [(9, i, "user" if i % 2 else "assistant", f"{i}") for i in range(70)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS tree", "2 AS id", "'z' AS formatted").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op12_chat_formatting"](spark, str(tmp_path)).collect()}
    odd = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(learnt), digest(learnt), len(chat.write(turns)[0]))
