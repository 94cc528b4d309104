import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetloom.llm import chat_format as c
from facetloom.llm import registry

CONTROL = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<|end|>\n", "<|:user|>\n", "\\", "<\\|", "[\\INST]", "|\\>", "<", "|", ">", "[", "\n", "x", "é", " "]
pieces = st.lists(st.sampled_from(CONTROL), max_size=8).map("".join)


def python_escape(text):
    return re.sub(rf"({c.OPENERS})(\\*){c.TAILS}", r"\1\\\2", text)


def python_unescape(text):
    return re.sub(rf"({c.OPENERS})\\(\\*){c.TAILS}", r"\1\2", text)


@given(pieces)
@settings(max_examples=2000)
def test_escape_is_reversible_and_hides_control_strings(text):
    held = python_escape(text)
    assert python_unescape(held) == text
    assert not re.search(r"<\||\|>|</?s>|\[/?INST\]", held)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    """Digests straight from the turns."""
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn if turn is not None else float("-inf"), role or "", text or ""))
    out = {}
    for conv, turns in chats.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def digests(df, **k):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in c.digests(c.format_chats(df, **k)).collect()}


def test_round_trip(spark):
    @given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["system", "user", "assistant", "end", "", "<|", "a|>\n", ">\n", None]), pieces | st.none()), max_size=40), st.integers(8, 60), st.integers(0, 20))
    @settings(max_examples=12, deadline=None)
    def run(turns, budget, history):
        rows = [(conv, at, role, text) for at, (conv, role, text) in enumerate(turns)]
        df = spark.createDataFrame(rows, SCHEMA)
        assert digests(df, budget=budget, history=history) == expected(rows)
        shown = lambda together: sorted(map(str, c.format_chats(df, budget=budget, history=history, together=together).collect()))
        assert shown(True) == shown(False)

    run()


def long_chat(n, tokens=20, conv=1, system=True):
    rows = [(conv, 0, "system", "be good and kind")] if system else []
    return rows + [(conv, i + 1, "user" if i % 2 == 0 else "assistant", f"t{i} " + "w " * (tokens + i % 7)) for i in range(n)]


def test_windows(spark):
    rows = long_chat(200) + long_chat(9, conv=2, system=False)
    found = c.format_chats(spark.createDataFrame(rows, SCHEMA), budget=256, history=64).orderBy("conv_id", "window").collect()
    assert len(found) > 20 and not any(w["over_budget"] for w in found)
    for w in found:
        assert w["n_tokens"] <= 256
        starts_with_system = w["formatted"].startswith("<|:system|>\nbe good and kind<|end|>\n")
        assert starts_with_system == (w["conv_id"] == 1)
        assert w["formatted"].count("<|end|>\n") == w["n_turns"]
        assert w["n_repeated"] <= 2
        for s in w["loss_spans"]:
            before = w["formatted"][: s["start"]]
            assert before.endswith("<|:assistant|>\n") and w["formatted"][s["end"] :].startswith("<|end|>\n")
    # Each later window repeats the system turn and the turn before it, and masks both.
    first = [w for w in found if w["conv_id"] == 1]
    assert first[0]["n_repeated"] == 0 and all(w["n_repeated"] == 2 for w in first[1:])
    shown = [re.findall(r"\bt\d+\b", w["formatted"]) for w in first]
    assert all(b[0] == a[-1] for a, b in zip(shown, shown[1:], strict=False))
    learned = [t for w in first for s in w["loss_spans"] for t in re.findall(r"\bt\d+\b", w["formatted"][s["start"] : s["end"]])]
    assert learned == [f"t{i}" for i in range(1, 200, 2)]


def test_history_that_does_not_fit(spark):
    rows = long_chat(40, tokens=60)
    found = c.format_chats(spark.createDataFrame(rows, SCHEMA), budget=256, history=16).collect()
    assert all(w["n_repeated"] == (w["window"] > 0) for w in found)


def test_a_turn_beyond_the_budget_stays_whole(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "w " * 5000), (1, 2, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = c.format_chats(df, budget=64, history=8).collect()
    assert [w["over_budget"] for w in sorted(found, key=lambda w: w["window"])] == [True, False]
    assert digests(df, budget=64, history=8) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", None), (7, None, None, "x"), (7, 3, "assistant", "a"), (7, 3, "assistant", "a"), (7, 3, "user", "b"), (8, -5, "assistant", "é" * 3000), (9, 1 << 61, "assistant", "late")]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.selectExpr("*", "'x' AS window", "1 AS start", "2 AS n_turns", "3 AS segment")
    assert digests(extra) == digests(extra, together=True) == expected(rows)
    assert c.format_chats(df.limit(0)).collect() == c.format_chats(df.limit(0), together=True).collect() == []


def test_one_long_conversation_is_spread(spark):
    rows = long_chat(1500, tokens=3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert digests(df) == expected(rows)
    turns = df.selectExpr("concat('=', conv_id) AS key", "*").withColumn("tokens", c.n_tokens(F.col("text")))
    sums = c.place(turns, together=False)
    assert "hashpartitioning(key" in sums._jdf.queryExecution().executedPlan().toString() and sums.select("start").distinct().count() == len(rows)
    assert sorted(map(str, sums.select("start", "total", "lead", "system").collect())) == sorted(map(str, c.place(turns, together=True).select("start", "total", "lead", "system").collect()))


def test_texts_move_once_when_conversations_stay_together(spark, data):
    plan = registry.op8_chat_format(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    planted = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", planted), (-1, 1, "assistant", planted)]
    got = registry.op8_chat_format(spark, data).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == expected(rows)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_no_python_on_the_way(spark, data):
    plan = registry.op8_chat_format(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
