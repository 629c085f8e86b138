from __future__ import annotations

import hashlib
import random

import pytest

from quarry.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, loss string"


def rows():
    r = random.Random(7)
    marks = C.Template().marks()
    bits = [*marks, "\x1b", "\x1be", "\x1bca", "[", "</", "s>", "hello", " ", "é🙂", ""]
    out = [(-7, 0, "user", C.PLANTED, "x"), (-7, 1, "assistant", C.PLANTED, "x")]
    for k in range(60):
        for turn in range(r.randint(1, 8)):
            role = r.choice(["system", "user", "assistant", "tool", "[INST]", None]) if k % 5 == 0 else "user" if turn % 2 == 0 else "assistant"
            out.append((k, turn, role, None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 12))), None))
    return [*out, (None, 1, "user", "no id", None), (None, 0, "user", "no id", None), (3, 0, "user", "tie", None)]


def test_turns_and_loss_read_back(spark):
    said = rows()
    got = {r.conv_id: r for r in C.summaries(spark.createDataFrame(said, SCHEMA).repartition(5)).collect()}
    by: dict = {}
    for i, turn, role, text, _ in said:
        by.setdefault(i, []).append((turn, role or "", text or ""))
    assert got.keys() == by.keys()
    for i, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[i].n_turns == len(turns)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_segments_make_the_formatted_text(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    sums = {r.conv_id: r for r in C.summaries(df).collect()}
    out: dict = {}
    for r in sorted(C.segments(df).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.segment)):
        out.setdefault(r.conv_id, []).append((r.string, r.loss))
    reader = C.Reader(C.Template())
    for i, segs in out.items():
        text = "".join(s for s, _ in segs)
        assert len(text) == sums[i].formatted_chars and hashlib.sha256(text.encode()).hexdigest() == sums[i].formatted_sha256
        reader.start()
        assert sum(1 for k in range(0, len(text), 5) for _ in reader.feed(text[k : k + 5])) == sums[i].n_turns
        reader.finish()
        assert sum(len(reader.plain(s)) for s, loss in segs if loss) == sums[i].loss_chars


def test_machine_reports_wrong_orders(spark):
    said = [(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "a"), (3, 0, "user", "a"), (3, 1, "user", "b"), (4, 0, "system", "x")]
    got = {r.conv_id: r for r in C.summaries(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[k].valid, got[k].error_turn) for k in (1, 2, 3, 4)] == [(True, None), (False, 0), (False, 1), (False, None)]


def test_templates_that_cannot_be_read_back_are_refused():
    for wrong in ({"begin": "[INST"}, {"end": "]x["}, {"begin": ""}, {"begin": "\x1b<s>"}, {"escape": "ab"}, {"begin": "</s>"}, {"opens": {"user": "[U]"}}):
        with pytest.raises(ValueError):
            C.Template(**wrong)
    with pytest.raises(ValueError):
        C.Template(opens={str(k): f"[{k}]" for k in range(20)}, closes={str(k): f"[/{k}]" for k in range(20)})


def test_reader_is_fed_the_whole_output_by_pieces(monkeypatch):
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(C, "FEED", size)
        t = C.Template()
        c = C.Conversation(1, t, C.Formatter(t), C.Reader(t))
        for role, text in (("user", "[INST]"), ("tool", "x"), ("assistant", "</s>")):
            c.add(role, text)
        assert c.row()[1:5] == (3, hashlib.sha256(b"user\n[INST]\ntool\nx\nassistant\n</s>\n").hexdigest(), 4, hashlib.sha256(b"</s>").hexdigest())


def test_no_mark_stands_in_an_escaped_text():
    w, r = C.Formatter(C.Template()), C.Reader(C.Template())
    for t in ("[IN[INST]ST]", "<</s>/s>", "\x1bcb[INST]", "[ROLE][TEXT][/ROLE]"):
        e = w.escaped(t)
        assert not r.mark.search(e) and r.plain(e) == t


def test_empty_table(spark):
    assert C.summaries(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.segments(spark.createDataFrame([], SCHEMA)).collect() == []
