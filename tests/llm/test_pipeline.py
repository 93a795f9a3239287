"""Each stage of the pipeline on its own input, and odd conversations."""

import numpy as np
import pytest

import corpus_pipeline as pipeline
from framewright.llm import chat, queries
from framewright.llm.scratch import stored

from . import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf_dir), name.replace(" ", "-")))
    return tables


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_return_documents(stages):
    for df in stages[1:-1]:
        assert df.columns == pipeline.COLUMNS
        assert [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema]


def test_toxic_documents_go(spark, sf_dir, stages):
    rejected = {r.doc_id for r in queries.op2_toxicity(spark, sf_dir).collect() if r.predicted}
    assert set(by_id(stages[1])) == set(by_id(stages[0])) - rejected


def test_lines_go(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    sets = brute.line_sets(list(before.items()), 5)
    stays = brute.components(sets, brute.near(sets))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if stays.get((i, k), (i, k)) == (i, k)) for i, t in before.items()}
    assert after == {i: t for i, t in want.items() if t.strip() or t == before[i]}  # emptied documents go
    assert len(after) < len(before)


def test_emptied_documents_go_and_blank_ones_stay(spark, sf_dir):
    rows = [(1, "a line that is said twice in this corpus"), (2, "A line that is said twice in this corpus\n \n"), (3, ""), (4, None), (5, " \n"), (None, ""), (6, "another line")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in pipeline.drop_repeated_lines(spark, docs, sf_dir).collect()), key=str)
    assert got == sorted((r for r in rows if r[0] != 2), key=str)


def test_one_of_each_class_stays(stages):
    want = brute.near_duplicates(list(by_id(stages[2]).items()), 5)
    assert set(by_id(stages[3])) == {i for i, (_, c) in want.items() if i == c}


def test_one_row_of_each_class_stays_with_odd_ids(spark, sf_dir):
    copy, near, other = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c"))
    edited = near + " tail"
    rows = [(None, copy), (None, copy + " x"), (4, copy + " y"), (1, near), (1, near), (9, near), (None, edited)]
    rows += [(7, near), (7, other)]  # an id on a near copy and on a clean text
    rows += [(None, "only null ids " + other[5:]), (None, "only null ids " + other[5:]), (None, None), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, docs, sf_dir).collect()), key=str)
    texts = [(4, copy + " y"), (1, near), (3, ""), (3, ""), (None, None), (None, None)]
    # the last two texts are one class (55 of 60 words), whose smallest id is 7
    assert out == sorted([*texts, (7, other)], key=str)


def test_null_ids_alone_are_told_apart(spark, sf_dir):
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in ("a", "b")]
    docs = spark.createDataFrame([(None, t, "en", "s", 0) for t in texts * 3], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == texts


def test_contaminated_documents_go(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute.contamination(list(by_id(stages[3]).items()), items, 10)
    assert set(by_id(stages[4])) == {i for i, (_, hit, _) in want.items() if not hit}


def test_packing_holds_every_token_once(stages):
    rows = stages[5].collect()
    spans = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in rows)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans[:-1], spans[1:], strict=True))
    assert {r.doc_id for r in rows} == set(by_id(stages[4]))


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (None, 0, "user", "<|end|>"), (None, None, "assistant", "é́ </s> tail "), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df, queries._tokenizer("byte_bpe_50k.json"))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (2, 0), None: (2, len("é́ </s> tail ")), 2: (2, 2), 3: (1, 0)}
    assert chat.digests(chat.format_conversations(df.limit(0), queries._tokenizer("byte_bpe_50k.json"))).collect() == []


def test_long_conversations_come_in_segments(spark):
    df = spark.range(3000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('word ', 60) as text")
    path = queries._tokenizer("byte_bpe_50k.json")
    out = chat.format_conversations(df, path)
    rows = out.orderBy("segment").collect()
    assert len(rows) > 1
    text, spans = chat.render([("assistant" if i % 2 else "user", "word " * 60) for i in range(3000)])
    tokens = chat._tool(path).encode(text, add_special_tokens=False)  # the conversation as one piece
    assert "".join(r.formatted for r in rows) == text
    assert [i for r in rows for i in r.input_ids] == tokens.ids
    assert [(r.first_char + a, r.first_char + b) for r in rows for a, b in zip(r.token_start, r.token_end, strict=True)] == tokens.offsets
    where = np.array(tokens.offsets)
    assert [m for r in rows for m in r.loss_mask] == chat.loss_mask(spans, where[:, 0], where[:, 1]).tolist()
    assert [(r.first_turn, r.first_token) for r in rows] == [(sum(x.n_turns for x in rows[:i]), sum(len(x.input_ids) for x in rows[:i])) for i in range(len(rows))]
    (r,) = chat.digests(out).collect()
    assert (r.n_turns, r.loss_chars) == (3000, 1500 * 300)
