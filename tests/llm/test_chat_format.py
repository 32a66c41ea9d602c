"""Chat formatting: exact round trips, layouts, digests against Python."""
import hashlib
import json

from ledgerline.llm import chat_format as C
from pyspark.sql import functions as F
from tests_llm_util import frame, rows_of

HARD = ["", "</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|end|><|text|>", "[INST", "<", "<|", "\\", "a\\<|turn|>",
        "<<SYS>> x <</SYS>>", "<|end|", "é\U0001f600<|im_end|>\n\t\0x", "<|<|end|>|>", "[\\INST]"]


def digest(turns):
    flat = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), h(flat), len(loss), h(loss)


def test_digests_match_python(spark):
    rows = []
    for c in range(6):
        for i, t in enumerate(HARD * (c + 1)):
            rows.append((c, i, ("user", "assistant", "system")[(i + c) % 3], t))
    rows += [(None, 0, "user", "x"), (7, None, None, None), (7, None, None, None), (8, 1, "assistant", "b"),
             (8, 1, "assistant", "a"), (9, 0, "a<|end|>b", "<|turn|>"), (10, 0, "assistant", "y" * 300_000)]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c),
                     key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        want[c] = digest([(x[2], x[3]) for x in own])
    got = {r.conv_id: tuple(r)[1:5] for r in C.format_digest(C.records_of_rows(df)).collect()}
    assert got == want


def test_no_control_string_comes_from_a_text(spark):
    t = C.Template()
    df = frame(spark, [(s,) for s in HARD], "s string").select("s", t.escape(F.col("s")).alias("e"))
    for r in df.withColumn("b", t.unescape(F.col("e"))).collect():
        assert r.b == r.s
        assert not any(m in r.e for m in (t.open, t.body, t.close, *t.reserved))


def test_layouts_by_fingerprint(spark):
    recs = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]},
        {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "n", "output": "o"},
        {"prompt": "p", "completion": "c"}, {"question": "q", "answer": 7}, {"data": {"prompt": "p", "reply": "r"}},
        {"unknown": 1}, None, {"messages": []}, {"messages": [{"role": "user", "content": None}]}, [1], "x",
        {"system": "", "prompt": "p", "response": None},
    ]
    df = frame(spark, [(i, None if r is None else json.dumps(r), "z") for i, r in enumerate(recs)],
               "conv_id int, j string, turns string")
    got = rows_of(C.canonical_turns(df.withColumn("record", F.parse_json("j")), "record").select("conv_id", "layout", "turns"))
    T = lambda *x: [tuple(t) for t in x]
    want = [("messages", T(("system", "s"), ("user", "u"))), ("from_value", T(("user", "u"), ("assistant", "a"))),
            ("instruction_input", T(("user", "i"), ("assistant", "o"))),
            ("instruction_input", T(("user", "i\n\nn"), ("assistant", "o"))),
            ("prompt_completion", T(("user", "p"), ("assistant", "c"))), ("question_answer", T(("user", "q"), ("assistant", "7"))),
            ("nested_data", T(("user", "p"), ("assistant", "r"))), (None, []), (None, []), ("messages", []),
            ("messages", T(("user", ""))), (None, []), (None, []),
            ("prompt_response", T(("user", "p"), ("assistant", "")))]
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in got] == want


def test_metadata_parts_and_unknown_records(spark):
    T = lambda *x: [tuple(t) for t in x]
    two = T(("user", "u"), ("assistant", "a"))
    msgs = [{"role": "user", "content": "u", "timestamp": 3}, {"role": "assistant", "content": "a", "meta": {"x": [1]}}]
    cases = [
        ({"messages": msgs, "id": "7", "source": "web", "tags": ["t"]}, "messages", two),
        ({"messages": msgs, "system": "s"}, "system_messages", T(("system", "s")) + two),
        ({"messages": msgs, "system": None}, "system_messages", two),
        ({"prompt": "u", "prompt_id": "9", "messages": msgs}, "messages", two),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image", "url": "i"}, "y"]},
                       {"role": "assistant", "content": "a"}]}, "messages", T(("user", "x\n\ny"), ("assistant", "a"))),
        ({"messages": [{"role": "user", "content": []}]}, "messages", T(("user", ""))),
        ({"messages": [{"role": "user", "content": {"k": 1}}]}, "messages", T(("user", '{"k":1}'))),
        ({"messages": [{"role": "user", "content": "u"}, {"role": "assistant"}]}, "messages", T(("user", "u"), ("assistant", ""))),
        ({"conversations": [{"from": "human", "value": "u", "weight": 1}], "idx": 4}, "from_value", T(("user", "u"))),
        ({"turns": [{"turn": 1, "role": "user", "text": "u", "at": "2024"}], "lang": "en"}, "turns", T(("user", "u"))),
        ({"instruction": "i", "output": "o", "id": 3, "score": 0.5}, "instruction", T(("user", "i"), ("assistant", "o"))),
        ({"data": {"prompt": "p", "reply": "r", "n": 1}}, "nested_data", T(("user", "p"), ("assistant", "r"))),
        ({"messages": ["a", "b"]}, None, []), ({"messages": [msgs[0], "b"]}, None, []), ({"messages": "x"}, None, []),
        ({"messages": [{"body": "b"}]}, None, []), ({"foo": 1}, None, []), ({"foo": "z"}, None, []), ({"bar": 1}, None, []), (None, None, []),
    ]
    df = frame(spark, [(i, None if r is None else json.dumps(r), 5) for i, (r, _, _) in enumerate(cases)],
               "conv_id int, j string, unknown_print int")
    got = rows_of(C.canonical_turns(df.withColumn("record", F.parse_json("j")), "record")
                  .select("conv_id", "layout", "turns", "unknown_print"))
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in got] == [(name, turns) for _, name, turns in cases]
    prints = [r.unknown_print for r in got]
    assert all((p is None) == (r.layout is not None or cases[r.conv_id][0] is None) for p, r in zip(prints, got))
    assert prints[16] == prints[17] != prints[18]           # the same fields, whatever their types


def test_a_conversation_of_very_many_turns(spark):
    df = spark.range(40_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                    F.concat(F.lit("t<|end|>"), F.col("id").cast("string")).alias("text"))
    got = C.format_digest(C.records_of_rows(df)).first()
    assert tuple(got)[1:5] == digest([(("user", "assistant")[i % 2], f"t<|end|>{i}") for i in range(40_000)])


def test_empty_table_and_plan(spark):
    from ledgerline.llm.queries import op10_chat_format
    empty = frame(spark, [], "conv_id long, turn long, role string, text string, formatted int")
    assert C.format_digest(C.records_of_rows(empty)).count() == 0
    df = op10_chat_format(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    probe = df.where("conv_id = -1").first()
    s = "</s>[INST] ok [/INST]"
    assert tuple(probe)[1:5] == digest([("user", s), ("assistant", s)])
