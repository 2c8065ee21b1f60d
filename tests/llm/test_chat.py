"""Chat formatting: exact round trips, masks against plain string search, awkward rows, split conversations."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventlens.llm.chat import MARKS, ORACLE, _tokenizer, chat_report, escaped, format_conversations, rendered, span_mask, unescaped
from eventlens.llm.tokens import tokenizer_file

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BPE = tokenizer_file("byte_bpe_50k.json")
PIECES = st.lists(st.sampled_from([*MARKS, "<|endoftext|>", "<", "|", "\\", "<\\|", "|>", " ", "\n", "é", "🙂", "é", "word", "12"]), max_size=12).map("".join)


@settings(deadline=None)
@given(PIECES)
def test_escapes_are_reversible(text):
    assert unescaped(escaped(text)) == text and "<|" not in escaped(text)


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|im_sep|>"]), PIECES), max_size=5))
def test_mask_covers_the_spans(turns):
    text, spans = rendered(turns, "assistant")
    assert [unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    code = _tokenizer(BPE).encode(text, add_special_tokens=False)
    mask = span_mask(np.array(code.offsets, np.int64).reshape(-1, 2), spans)
    under = [any(a < e and s < b for a, b in spans) for s, e in code.offsets]
    assert mask.tolist() == under
    assert _tokenizer(BPE).decode(code.ids, skip_special_tokens=False) == text
    assert sum(i >= 50257 for i in code.ids) == 3 * len(turns)


def test_token_across_a_border_is_an_error():
    with pytest.raises(ValueError, match="crosses"):
        span_mask(np.array([(0, 3), (3, 6)]), [(2, 6)])


ROWS = [
    (None, None, None, None), (None, 1, "assistant", ""), (1, 2, "assistant", " lead\n\n"), (1, None, "user", "\n x"), (1, 2, "assistant", " lead\n\n"), (2, 0, "assistant", None),
    (3, 0, "<|im_start|>", "<|im_sep|>\\|<\\\\|"), (3, 1, "assistant", "<|endoftext|><|im_end|>"), (4, 0, "assistant", "long é " * 60_000), (4, 1, "Assistant", "not trained"),
    *[(9, t, "assistant" if t % 2 else "user", f"{t} {'y' * (t % 50)}") for t in range(300)],
]


def same(spark, rows, **limits):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(ORACLE)
    columns = [d[0] for d in found.description]
    df = chat_report(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "true as whole", "'x' as ids"), BPE, **limits)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("limits", [{}, {"part_chars": 500}, {"part_chars": 500, "hot_rows": 20}])
def test_awkward_rows(spark, limits):
    same(spark, ROWS, **limits)


def test_empty_table(spark):
    same(spark, [])


def test_parts_of_a_hot_conversation(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    stored = format_conversations(rows, BPE, part_chars=500, hot_rows=20).where("conv_id = 9").orderBy("part").collect()
    whole = format_conversations(rows, BPE).where("conv_id = 9").collect()
    assert len(stored) > 4 and len(whole) == 1 and whole[0].whole
    for column in ("text", "ids", "loss"):
        joined = [x for r in stored for x in r[column]]
        assert joined == list(whole[0][column])
