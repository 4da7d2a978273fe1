import random
import re

from inkveil.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turn_ string"


def _run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op7_chat_windows(spark, str(tmp_path)).collect()}


def test_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    marks = ["<|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<\\|im_end|>", "<", "\n", "é", "ok", "<s>"]
    rows = []
    for conv in range(25):
        for turn in range(rng.choice([1, 2, 7, 40])):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, " ".join(rng.choice(marks) for _ in range(rng.choice([0, 3, 60, 700]))), "x"))
    rows += [(100, 0, None, None, None), (100, 1, "assistant", None, None), (None, 0, "user", "a", None), (None, None, "assistant", "b", None), (101, 5, "assistant", "b", None), (101, 5, "assistant", "b", None), (101, 5, "assistant", "a", None)]
    probe = [(-7, 0, "user", chat.PROBE[2]), (-7, 1, "assistant", chat.PROBE[2])]
    assert _run(spark, tmp_path, rows) == chat.brute([r[:4] for r in rows] + probe)


def test_empty_table(spark, tmp_path):
    assert set(_run(spark, tmp_path, [])) == {-7}


def test_windows_keep_budget_and_system_turn(spark):
    rows = [(1, 0, "system", "rules here")] + [(1, i, ("user", "assistant")[i % 2], "w " * 40) for i in range(1, 50)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("window").collect()
    assert len(out) > 3
    assert all(r.formatted.startswith("<|im_start|>system<|im_sep|>rules here<|im_end|>") for r in out)
    assert out[0].context == 0 and all(1 < r.context <= 4 for r in out[1:])
    assert sum(len(r.targets) for r in out) == 25
    assert all("<|im_" not in r.formatted[s.start : s.start + s.length] for r in out for s in r.targets)


def test_one_long_conversation(spark, tmp_path):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}", None) for i in range(3000)]
    probe = [(-7, 0, "user", chat.PROBE[2]), (-7, 1, "assistant", chat.PROBE[2])]
    assert _run(spark, tmp_path, rows) == chat.brute([r[:4] for r in rows] + probe)


def test_no_window_exceeds_its_budget(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(40):
        system = rng.choice([0, 2, 60, 300, 505, 700])
        rows += [(conv, 0, "system", "s " * system)] if system else []
        rows += [(conv, i, ("user", "assistant")[i % 2], "w " * rng.choice([0, 1, 20, 90, 200, 370, 480, 509, 600])) for i in range(1, rng.choice([2, 9, 60]))]
    rows += [(100, 0, "user", "w " * 97), (100, 1, "assistant", "w " * 597)]
    rows += [(101, i, ("user", "assistant")[i % 2], "w " * (i % 70)) for i in range(2500)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    new, wide = {}, 0
    for r in sorted(out, key=lambda r: (r.conv_id, r.window)):
        lines = r.formatted.split(chat.END)[:-1]
        tokens = [len(re.findall(chat.WORD, x.split(chat.SEP, 1)[1])) + chat.MARKS for x in lines]
        assert sum(tokens) <= chat.BUDGET or len(lines) == 1
        assert r.context < len(lines)
        said = [x for x in lines[: r.context] if "system" not in x.split(chat.SEP)[0]]
        earlier = new.setdefault(r.conv_id, [])
        assert said == earlier[len(earlier) - len(said) :]
        wide += len(lines) > r.context + 1
        earlier += lines[r.context :]
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append(f"{chat.START}{role}{chat.SEP}{text}")
    assert new == want and wide > 50
    assert [r.context for r in sorted(out, key=lambda r: r.window) if r.conv_id == 100] == [0, 0]
    last = max((r for r in out if r.conv_id == 101), key=lambda r: r.window)
    assert last.context > 0
