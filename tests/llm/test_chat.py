"""Chat formatting: round trips, masks and layouts."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.llm import chat, queries

HOSTILE = ["\\### Assistant: </turn> ok", "</turn>", "<turn>### x ###\n", "####", "\\", "\\\\<\\turn>", "", "#", " ###\n", "a\n</turn>\nb", "<</turn>>", "\\n", "é\U0001f600"]


def test_hostile_turns_come_back(spark):
    rows = [(c, t, r, x) for c, (r, x) in enumerate((r, x) for r in ["user", "assistant", "", "a ###\n", "##", None] for x in [*HOSTILE, None]) for t in (0, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.render(chat.canonical_turns(df))).collect()
    want = {c: (r or "", x or "") for c, _, r, x in rows}
    for r in got:
        assert [(t.role, t.text) for t in r.read_turns] == [want[r.conv_id]] * 2
        lost = "".join(r.loss_texts)
        assert lost == (want[r.conv_id][1] * 2 if want[r.conv_id][0] == "assistant" else "")
        assert sum(x.plain + x.loss + x.tail for x in r.loss_runs) == len(r.formatted)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="\\<>/turn# \n€", max_size=30), min_size=1, max_size=20))
def test_any_text_comes_back(spark, texts):
    df = spark.createDataFrame([(1, i, "assistant", x) for i, x in enumerate(texts)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.render(chat.canonical_turns(df))).first()
    assert [t.text for t in r.read_turns] == texts


def test_query_digests(spark, sf):
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    by[-7] = [(0, "user", queries.HOSTILE), (1, "assistant", queries.HOSTILE)]
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        lost = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())


RECORDS = [
    ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', "messages", [("user", "hi"), ("assistant", "yo")]),
    ('{"system":"be","messages":[{"role":"user","content":"hi"}]}', "messages_system", [("system", "be"), ("user", "hi")]),
    ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}],"id":7}', "from_value", [("user", "a"), ("assistant", "b")]),
    ('{"instruction":"do","input":"x","output":"y"}', "instruction_input", [("user", "do\n\nx"), ("assistant", "y")]),
    ('{"instruction":"do","input":"","output":"y"}', "instruction_input", [("user", "do"), ("assistant", "y")]),
    ('{"instruction":"do","output":"y","lang":"en"}', "instruction", [("user", "do"), ("assistant", "y")]),
    ('{"prompt":"p","completion":"c"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ('{"prompt":"p","response":null}', "prompt_response", [("user", "p"), ("assistant", "")]),
    ('{"question":"q","answer":"a"}', "question_answer", [("user", "q"), ("assistant", "a")]),
    ('{"other":1}', None, None),
    ("not json", None, None),
    (None, None, None),
]


def test_records_by_fingerprint(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(RECORDS)], "id long, rec string")
    got = {r.id: r for r in chat.canonical_records(df, "rec", "id").collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout == layout
        assert (got[i].turns and [(t.role, t.text) for t in got[i].turns]) == turns


def test_tables_by_fingerprint(spark):
    df = spark.createDataFrame([(1, "q", "a", 5)], "conv_id long, question string, answer string, extra int")
    assert [(t.role, t.text) for t in chat.canonical_turns(df).first().turns] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, x int"))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, None, "user", "b"), (1, 0, "user", "z"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    df = df.withColumn("prompt", F.lit("x")).withColumn("response", F.lit("y")).withColumn("formatted", F.lit("f"))
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.canonical_turns(df).collect()}
    assert got == {None: [""], 1: ["b", "a", "a", "z"]}
    assert chat.render(chat.canonical_turns(df.limit(0))).count() == 0
    long = spark.createDataFrame([(1, 0, "assistant", "</turn>#" * 200_000)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.render(chat.canonical_turns(long))).first().loss_texts[0] == "</turn>#" * 200_000


def test_odd_records_and_tables(spark):
    """Known fields beside a layout's, columns named as the plan's own might be, null arrays, empty tables and repeated rows."""
    rows = [(1, '{"prompt": "p", "completion": "c", "system": "s"}'), (1, '{"prompt": "p", "completion": "c", "system": "s"}'), (2, None), (3, "{"), (4, '{"messages": []}')]
    df = spark.createDataFrame(rows, "v long, fingerprint string")
    got = chat.canonical_records(df, "fingerprint", "v").orderBy("v").collect()
    assert [(r.v, r.layout) for r in got] == [(1, "prompt_completion")] * 2 + [(2, None), (3, None), (4, None)]
    assert [tuple(t) for t in got[0].turns] == [("user", "p"), ("assistant", "c")]
    assert chat.canonical_records(df.limit(0), "fingerprint", "v").count() == 0
    kind = "conv_id long, system string, messages array<struct<role:string,content:string>>"
    table = spark.createDataFrame([(1, "s", None), (2, None, [("user", None)])], kind)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonical_turns(table).collect()}
    assert got == {1: [("system", "s")], 2: [("system", ""), ("user", "")]}
    assert chat.canonical_turns(table.limit(0)).count() == 0
