import hashlib
import random

import duckdb
import pytest

from hostelry.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said))
    return out


ODD = ["", None, "~", "~0~1", "<s>", "</s>\n", "<|user|>\n", "|>\n", "[INST]", "é中\U0001f600", "a\nb\n", " ", "~~<[", "x" * 5000]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [(c, t, rng.choice(["user", "assistant", "system", None, "a|>\nb", "tool<"]), rng.choice(ODD))
            for c in range(60) for t in range(rng.randint(1, 9))]
    return made + [(1, 0, "assistant", "tie"), (1, 0, "assistant", "tie"), (None, None, None, None)]


def test_read_back_equals_what_went_in(spark, rows):
    made = chat.examples(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == expected(rows)


def test_every_assistant_turn_is_an_example_with_only_itself_trainable(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q<1"), (1, 2, "assistant", "a[1"), (1, 3, "user", "q2"), (1, 4, "assistant", "a2"),
            (1, 5, "user", "rest")]
    made = chat.examples(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    assert [r.example for r in made] == [3, 5, 6]
    assert [r.text[r.loss_start:r.loss_start + r.loss_length] for r in made] == ["a~21", "a2", ""]
    assert made[0].text == "<s><|system|>\ns</s>\n<|user|>\nq~11</s>\n<|assistant|>\na~21</s>\n"
    assert all(b.text.startswith(a.text) for a, b in zip(made, made[1:]))
    assert [r.last for r in made] == [False, False, True]


def test_main_path_has_no_python(spark, rows):
    plan = chat.digests(chat.examples(spark.createDataFrame(rows, SCHEMA).limit(5)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_other_columns(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert chat.digests(chat.examples(df.limit(0))).collect() == []
    more = df.selectExpr("*", "1 as example", "2 as last", "3 as turns_", "4 as target_")
    assert sorted(map(str, chat.digests(chat.examples(more)).collect())) == sorted(map(str, chat.digests(chat.examples(df)).collect()))


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op4_chat(spark, folder)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = con.execute(queries.SQL["op4_chat"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())
