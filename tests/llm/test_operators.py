"""Every operator against plain Python, on a driver table and on one of odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from framewright.llm import decontaminate, langid, line_dedup, media, near_dedup, packing, queries, suffix_dedup, token_files, toxicity

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, component string, keys string, part int, found string"


def odd_rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta", "über", "x", "omega", "thing", "of", "the", "naïve", "zeta"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(3000))
    lines = [" ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(14)) for _ in range(12)]
    edited = long.replace("omega", "OMEGA").replace("alpha7 ", "alpha8 ")
    texts = [None, "", " \n\t ", "one", "ONE", "one two", long, long, edited, "\n".join(lines), "\n".join(lines[:6] + [lines[7] + "!"] + lines[8:]), long[700:9000] + "tail", "a" * 1500, "b" + "a" * 700, "... !!"]
    texts += [" ".join(rng.choice(words) for _ in range(40)) for _ in range(10)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "c", "k", 0, "f") for i, t in odd_rows()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None,) * 10, (None, "some text", *(None,) * 8), (3, "some text", *(None,) * 8), (3, "some text", *(None,) * 8)], SCHEMA)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, sf_dir, odd, size):
    for df in (odd, documents(spark, sf_dir)):
        want = brute.near_duplicates(pairs(df), size)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, size=size).collect()}
        assert got == want


def test_near_duplicates_of_nothing_and_nulls(empty, nulls):
    assert near_dedup.near_duplicates(empty).collect() == []
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(nulls).collect())
    assert got == [(0, 0, None, True), (0, 1, 3, False), (3, 1, 3, True), (3, 1, 3, True)]


def test_near_duplicates_that_meet_without_links(spark, monkeypatch):
    """Texts of one passage that aren't linked, and copies of copies on both sides of the threshold, through the prefixes."""
    from framewright.llm import setjoin

    rng = np.random.default_rng(9)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, base = words(90), words(120)
    texts = [words(20) + passage + words(20) for _ in range(40)]
    for i in range(60):
        copy = list(base)
        for at in rng.choice(120, 1 + i % 4, replace=False):
            copy[at] = f"e{i}-{at}"
        texts.append(copy)
    docs = list(enumerate(" ".join(t) for t in texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen, prefixes = [], setjoin._Verifier.prefixes

    def counted(self, nodes):
        out = prefixes(self, nodes)
        seen.append(nodes.count())
        return out

    monkeypatch.setattr(setjoin._Verifier, "prefixes", counted)
    want = brute.near_duplicates(docs, 5)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, size=5).collect()}
    assert got == {i: (w if isinstance(w, int) else w[1]) for i, w in want.items()} and seen


@pytest.mark.parametrize("small", [4, 512])
def test_lines_that_meet_in_small_and_large_buckets(spark, monkeypatch, small):
    """Buckets of at most SMALL members give no row of a shingle; larger ones give those of prefixes, a fifth of all or fewer."""
    from framewright.llm import setjoin

    rng = np.random.default_rng(4)
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    base, docs = letters(200), []
    for i in range(120):
        line = list(base)
        for at in rng.choice(200, 1 + i % 10, replace=False):
            line[at] = str(i % 10)
        docs.append((i, "".join(line)))
    monkeypatch.setattr(setjoin, "SMALL", small)
    names, stored = [], setjoin.stored

    def kept(df, name, *a):
        out = stored(df, name, *a)
        names.append((name, out.count()))
        return out

    monkeypatch.setattr(setjoin, "stored", kept)
    sets = brute.line_sets(docs, line_dedup.SHINGLE)
    stays = brute.components(sets, brute.near(sets))
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {i: int(stays.get((i, 0), (i, 0)) != (i, 0)) for i, _ in docs}
    rows = dict(names)
    assert "shingles" not in rows and ("prefixes" in rows) == (small == 4)
    assert rows.get("prefixes", 0) <= 0.25 * sum(len(s) for s in sets.values())


def test_lines_that_meet_in_middling_buckets_are_read_once(spark, monkeypatch):
    """Buckets of up to TIMES * SMALL members write no prefixes, and the lines' texts are held in one table."""
    from framewright.llm import setjoin

    rng = np.random.default_rng(4)
    base, docs = [chr(97 + x) for x in rng.integers(0, 26, 200)], []
    for i in range(120):
        line = list(base)
        for at in rng.choice(200, 1 + i % 10, replace=False):
            line[at] = str(i % 10)
        docs.append((i, "".join(line)))
    monkeypatch.setattr(setjoin, "SMALL", 16)
    names, stored = [], setjoin.stored
    monkeypatch.setattr(setjoin, "stored", lambda df, name, *a: names.append(name) or stored(df, name, *a))
    sets = brute.line_sets(docs, line_dedup.SHINGLE)
    stays = brute.components(sets, brute.near(sets))
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {i: int(stays.get((i, 0), (i, 0)) != (i, 0)) for i, _ in docs}
    assert "prefixes" not in names and "items" not in names


def test_line_dedup(spark, sf_dir, odd):
    for df in (odd, documents(spark, sf_dir)):
        docs = pairs(df)
        sets = brute.line_sets(docs, line_dedup.SHINGLE)
        stays = brute.components(sets, brute.near(sets))
        want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if stays.get((i, k), (i, k)) == (i, k)) for i, t in docs}
        out = line_dedup.dedup_lines(df)
        assert set(df.columns) < set(out.columns)
        assert {r.doc_id: r.text for r in out.collect()} == want


@pytest.mark.parametrize("line", ["Posted by Anna on 12 March 2021 at the front page, all rights reserved", "Все права защищены, страница обновлена 12 марта 2021 года, читать далее", "本網站所有內容均受版權保護未經許可不得轉載或複製更新日期二零二一年三月十二日請點擊此處閱讀全文了解更多詳情謝謝"])
def test_one_letter_edits_of_short_lines_are_found(spark, line):
    assert len(line) < 79
    edited = line[:30] + "ж" + line[31:]  # one letter in mid-line
    size = 5  # of its own, in code points
    a, b = ({x[i : i + size] for i in range(len(x) - size + 1)} for x in (line, edited))
    assert 100 * len(a & b) >= 80 * len(a | b)
    docs = spark.createDataFrame([(1, line), (2, "ab\n" + edited), (3, line[:20]), (4, "ab")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {1: line, 2: "ab", 3: line[:20], 4: ""}


def test_shingles_are_code_points():
    lines = ["naïve ÜBER", "ab", "日本語", "日本語の文章", "", "😀😀😀😀😀😁", "abcde", "x"]
    raw = [x.encode() for x in lines]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.cumsum([0, *map(len, raw)])
    hashes, first = line_dedup.shingle_hashes(data, off[:-1][off[1:] > off[:-1]], off[1:][off[1:] > off[:-1]])
    want = [brute.low(x)[i : i + 5] for x in lines if x for i in range(max(1, len(x) - 4))]
    assert len(hashes) == len(want) == first[-1] and len(set(zip(want, hashes.tolist()))) == len(set(want)) == len(set(hashes.tolist()))


def test_line_dedup_of_nothing_and_nulls(empty, nulls):
    assert line_dedup.dedup_lines(empty).collect() == []
    got = sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in line_dedup.dedup_lines(nulls).collect())
    assert got == [(0, "", 0), (0, "some text", 0), (3, "", 1), (3, "", 1)]


@pytest.mark.parametrize("merge_bytes", [10_000, suffix_dedup.MERGE_BYTES])
def test_repeats(spark, sf_dir, odd, merge_bytes):
    import pyspark.sql.functions as F

    for df in (odd, documents(spark, sf_dir)):
        out = suffix_dedup.remove_repeats(df, merge_bytes=merge_bytes).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("gone"), F.size("removed").alias("n"), F.sha2("kept", 256).alias("sha"))
        assert {r.doc_id: (r.n_bytes, r.gone, r.n, r.sha) for r in out.collect()} == brute.repeats(pairs(df), suffix_dedup.LENGTH)


def test_repeats_read_in_blocks(spark, odd, monkeypatch):
    docs = pairs(odd)
    monkeypatch.setattr(suffix_dedup, "READ_BYTES", 1000)  # of the driver, so check the reader itself
    raw = np.frombuffer(docs[6][1].encode(), np.uint8)
    whole = {(int(f) + k) for f, m, *_ in zip(*suffix_dedup.ranges(raw, np.array([0, len(raw)])), strict=True) for k in range(m)}
    cut = {skipped + int(f) + k for _, part, where, skipped in suffix_dedup._blocks(raw, np.array([0, len(raw)])) for f, m, *_ in zip(*suffix_dedup.ranges(part, where), strict=True) for k in range(m)}
    assert whole == cut == set(range(len(raw) - suffix_dedup.LENGTH + 1))


def test_repeats_around_one_frequent_anchor(spark):
    """Bodies that share an anchor, or 399 bytes, or a long passage, in shards far smaller than all of them."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared, passage = word(399), word(700)
    texts = [f"{word(250)}{shared[100:200]}{word(250)}" for _ in range(12)]
    texts += [f"{word(200)}{'AB'[i % 2]}{shared}{'CD'[i // 2 % 2]}{word(200)}" for i in range(12)]
    texts += [word(30 * i) + passage[:650 + i] + word(20) for i in range(12)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.repeats(docs, suffix_dedup.LENGTH)
    for merge_bytes in (2000, 5000):
        out = suffix_dedup.remove_repeats(df, merge_bytes=merge_bytes).collect()
        got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in out}
        assert got == want


def test_repeats_of_a_repeated_unit_are_few_rows():
    import pyarrow as pa

    texts = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "doc_hash": [5, 6], "text": ["ab" * 300_000, "abc" * 1000]})
    rows = [r for batch in suffix_dedup._ranges([texts]) for r in batch.to_pylist()]
    assert len(rows) < 20 and sum(r["here"] * r["many"] for r in rows) == 600_000 + 3000 - 2 * (suffix_dedup.LENGTH - 1)
    for doc, size in ((1, 600_000), (2, 3000)):
        assert {(min(r["start"] for r in rows if r["doc_id"] == doc), max(r["end"] for r in rows if r["doc_id"] == doc))} == {(0, size)}


def test_repeats_of_nothing_and_nulls(empty, nulls):
    assert suffix_dedup.remove_repeats(empty).collect() == []
    assert sorted(bytes(r.kept) for r in suffix_dedup.remove_repeats(nulls).collect()) == [b"", *[b"some text"] * 3]


def test_decontamination(spark, sf_dir, odd):
    items = [(0, "thing of the"), (1, None), (2, "..."), (3, odd_rows()[6][1][300:420]), (None, "one"), (10, "One")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    other = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    for df, table in ((odd, bench), (documents(spark, sf_dir), other)):
        known = [(r.item_id, r.text) for r in table.collect() if r.item_id is not None]
        want = brute.contamination(pairs(df), known, decontaminate.WINDOW)
        out = decontaminate.decontaminate(df, table)
        got = {r.doc_id: (r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in out.collect()}
        assert got == {i: (n, h, hashlib.sha256(s.encode()).hexdigest(), h > 0) for i, (n, h, s) in want.items()}
        assert set(df.columns) < set(out.columns)


def test_decontamination_of_nothing(spark, empty, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(odd, bench).collect())


def encoded(name, text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = encoded.tools.setdefault(name, Tokenizer.from_file(public_tokenizers.path(name)))
    return [*tool.encode(text or "", add_special_tokens=False).ids, end]


encoded.tools = {}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, sf_dir, odd):
    for df in (odd, documents(spark, sf_dir)):
        pieces = packing.pack(df, queries._tokenizer("byte_bpe_50k.json"))
        rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
        at = 0
        for r in rows:
            assert r.sequence_id * 2048 + r.offset == at and r.offset + r.length <= 2048 and r.length > 0
            at += r.length
        by = {}
        for r in sorted(rows, key=lambda r: r.start):
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length and len(by.setdefault(r.doc_id, [])) == r.start
            by[r.doc_id] += ids
            want = encoded("byte_bpe_50k.json", dict(pairs_cached(df))[r.doc_id], 1) if len(by[r.doc_id]) == r.doc_tokens else None
            assert want is None or want == by[r.doc_id]
        assert set(by) == {i for i, _ in pairs_cached(df)}
        full = packing.sequences(pieces).collect()
        assert all(len(r.ids) == 4 * 2048 for r in full) and sum(r.n_tokens for r in full) == at and sum(r.n_tokens < 2048 for r in full) <= 1


_pairs: dict[int, list] = {}


def pairs_cached(df):
    if id(df) not in _pairs:
        _pairs[id(df)] = pairs(df)
    return _pairs[id(df)]


def test_packing_of_nothing_and_nulls(empty, nulls):
    path = queries._tokenizer("byte_bpe_50k.json")
    assert packing.pack(empty, path).collect() == []
    assert sorted(r.length for r in packing.pack(nulls, path).collect()) == [1, 3, 3, 3]


def test_token_files(spark, sf_dir, odd, empty, nulls, tmp_path):
    path = queries._tokenizer("word_bpe_49k.json")
    for df in (odd, documents(spark, sf_dir)):
        files = token_files.write_token_files(df, path)
        got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
        at = 0
        for r, (i, text) in zip(got, sorted(pairs(df)), strict=True):
            want = encoded("word_bpe_49k.json", text, 2)
            assert (r.doc_id, r.start, r.n_tokens, crc(np.frombuffer(r.ids, "<u4"))) == (i, at, len(want), crc(want))
            at += len(want)
        assert token_files.export(files, tmp_path) == files.count()
    assert token_files.read_token_files(token_files.write_token_files(empty, path)).collect() == []
    got = token_files.read_token_files(token_files.write_token_files(nulls, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3, 3]


def test_text_images(spark, sf_dir, odd):
    out = media.features(media.text_images(odd), extra=media.payload_digests, extra_schema=media.PAYLOAD).collect()
    for r, (_, text) in zip(sorted(out, key=lambda r: r.doc_id), odd_rows(), strict=True):
        raw = (text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.error is None and len(r.dhash) == 16 and bytes(r.tile[:6]) == b"\x93NUMPY"


def test_media_of_odd_cells(spark):
    df = spark.createDataFrame([(1, None), (2, b"junk"), (3, b"P5\n9 9\n255\n"), (4, media.encode_bmp(np.zeros((3, 3, 3), np.uint8)))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.features(df).collect()}
    assert got[1].error == "null" and got[2].error and got[3].error and got[4].error is None and got[4].dhash == "0" * 16


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op2_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    # more than a tenth of the toxic labels is noise: texts without any term that tells
    assert sum(s >= 0.7 for s in toxic) >= 0.8 * len(toxic) and sum(s >= 0.7 for s in clean) <= 0.01 * len(clean)
    assert docs.count() > len(rows)


def test_pairs_of_terms_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 6)) < 0.5
    label = (x[:, 0] == x[:, 1]).astype(float)  # added weights alone can't tell these apart
    first = np.append(0, np.cumsum(x.sum(axis=1)))
    inputs = np.nonzero(x)[1]
    bias, weight, factor = toxicity.learn(first, inputs, label, 6)
    machine = toxicity.Machine(np.zeros(1, np.int16), bias, weight, factor)
    assert ((machine.scores(first, inputs) > 0.5) == (label > 0.5)).mean() > 0.98
    assert factor[0] @ factor[1] > 0.5


def test_pairs_that_tell_nothing_alone_are_learned_from_texts(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in "klmn"]
    rows = []
    for i in range(1600):
        insult, group = i % 2, i // 2 % 2
        text = rng.sample(words, 12) + ["zorp"] * insult + ["quib"] * group
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(insult == group)))  # each of the two words is as common in either label
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    machine = toxicity.fit(docs.where("doc_id < 1200"))
    held = toxicity.score(docs.where("doc_id >= 1200"), machine, threshold=0.5).collect()
    assert sum(r.predicted == r.label for r in held) >= 0.95 * len(held)


def test_toxicity_of_nothing_and_nulls(spark, empty, nulls, odd):
    none = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert toxicity.score(empty, none).collect() == []
    assert {r.predicted for r in toxicity.score(nulls, none).collect()} == {0}
    one = toxicity.fit(spark.createDataFrame([(1, None, 1), (2, "x", None), (3, "", 1)], "doc_id long, text string, label int"))
    assert len(toxicity.score(odd, one).collect()) == len(odd_rows())


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in documents(spark, sf).collect()}
    rows = [r for r in queries.op6_language_id(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_nothing_and_nulls(spark, empty, nulls, odd):
    none = langid.fit(empty)
    assert langid.predict(empty, none).collect() == []
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    known = langid.fit(odd)
    got = {(r.text, r.lang_pred) for r in langid.predict(odd, known).collect()}
    assert {p for t, p in got if not t or not any(c.isalpha() for c in t)} == {"und"} and ("one", "en") in got
    assert len(langid.predict(nulls, known).collect()) == 4


def test_scores_are_those_of_all_pairs():
    rng = np.random.default_rng(8)
    machine = toxicity.Machine(np.zeros(1, np.int16), -0.3, rng.normal(0, 0.5, 12), rng.normal(0, 0.4, (12, toxicity.FACTORS)))
    rows = [sorted(rng.choice(12, int(n), replace=False).tolist()) for n in rng.integers(0, 9, 40)]
    first = np.append(0, np.cumsum([len(r) for r in rows]))
    got = machine.scores(first, np.array([i for r in rows for i in r], np.int64))
    for r, s in zip(rows, got, strict=True):
        z = machine.bias + sum(machine.weight[i] for i in r) + sum(float(machine.factor[i] @ machine.factor[j]) for k, i in enumerate(r) for j in r[k + 1 :])
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9


def test_telling_pairs_are_those_of_all_pairs(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(9)
    monkeypatch.setattr(toxicity, "PAIR_COLUMNS", 4)
    monkeypatch.setattr(toxicity, "PAIRS", 50)
    x = rng.random((900, 10)) < 0.3
    x[:, 9] &= x[:, 2]
    seen, expected = rng.random(900) < 0.2 + 0.5 * (x[:, 1] & x[:, 6]), np.full(900, 0.2)
    first, inputs = np.append(0, np.cumsum(x.sum(axis=1))), np.nonzero(x)[1].astype(np.int32)
    shared = SimpleNamespace(value=(first, inputs, np.argsort(inputs, kind="stable"), seen, expected))
    out = toxicity._telling_pairs(shared, 10)([pa.RecordBatch.from_arrays([pa.array([0, 1, 2])], names=["id"])])
    want = set()
    for i in range(10):
        for j in range(10):
            both = x[:, i] & x[:, j]
            n, e = (both & seen).sum(), expected[both].sum()
            if i != j and n > e and 2 * (n * np.log(n / e) - n + e) >= toxicity.LEAST_PAIR_RATIO:
                want.add(j)
    assert {int(v) for b in out for v in b.column(0).to_pylist()} == want and {1, 6} <= want


def test_the_sample_is_bounded_and_of_different_rows(spark):
    docs = spark.range(4000).selectExpr("if(id % 5 = 0, 7, id) as doc_id", "concat('text ', id % 900) as text").unionByName(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    labels = spark.range(4000).selectExpr("id as doc_id", "if(id % 7 = 0, null, int(id % 2)) as label")
    known = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.doc_id % 7}
    for rows in (0, 50, 100_000):
        got = [(r.doc_id, r.text) for r in toxicity.sample(docs, labels, rows).collect()]
        assert len(got) == len(set(got)) == min(rows, len(known)) and set(got) <= known


def _profile(text):
    row = [0]
    for c in text or "":
        place = 1 + ord(c.lower()[0]) % (langid.LETTERS - 1) if c.isalpha() else 0
        if place or row[-1]:
            row.append(place)
    v, out = langid.letter_vectors().astype(np.int64), np.zeros(langid.SIZE)
    grams = [tuple(row[i : i + 3]) for i in range(len(row) - 2)] + ([(*row[-2:], 0)] if len(row) > 1 and row[-1] else [])
    for a, b, c in grams:
        out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out / (np.linalg.norm(out) or 1)


def test_predictions_are_those_of_plain_profiles(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "the bird in the tree", "en"), (3, "der Hund und die Katze", "de"), (4, "die Äpfel im Baum", "de"), (5, None, "de"), (6, "7 8", "en"), (7, "ab", None)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = ["the dog", "die Katze und der Baum", "b", "  x-y  ", "Привет мир", "cat " * 50]
    sums = {k: sum(np.rint(_profile(t) * langid._SCALE) for _, t, lang in rows if lang == k and t and any(c.isalpha() for c in t)) for k in ("de", "en")}
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in ("de", "en")])
    mean = unit.mean(axis=0)
    unit = (unit - mean) / np.linalg.norm(unit - mean, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, t, "old", 2.0) for i, t in enumerate(asked)], "doc_id long, text string, lang_pred string, score double")
    for r in langid.predict(docs, langid.fit(known)).collect():
        v = _profile(asked[r.doc_id]) - mean
        near = unit @ v / np.linalg.norm(v)
        assert r.lang_pred == ("de", "en")[near.argmax()] and abs(r.score - (1 + near.max()) / 2) < 1e-4


def test_tables_that_have_the_new_columns_already(spark, empty, nulls):
    docs = spark.createDataFrame([(1, "some words here", 9.0, 4, "q", True)], "doc_id long, text string, score double, predicted int, lang_pred string, __hits boolean")
    machine = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert toxicity.score(docs, machine).collect()[0].predicted == 0
    bench = spark.createDataFrame([("i", "some words")], "item_id string, text string")
    (r,) = decontaminate.decontaminate(docs.withColumn("row", docs.text).withColumn("hash", docs.score).withColumn("found", docs.text), bench).collect()
    assert (r.n_hit, r.n_items, r["__hits"], r.row, r.hash, r.found) == (2, 1, True, "some words here", 9.0, "some words here")
    cut = line_dedup.dedup_lines(docs.selectExpr("doc_id", "text", "score as __id", "score as __hash", "text as __gone", "score as id", "score as hash", "text as row"))
    assert cut.columns == ["doc_id", "text", "__id", "__hash", "__gone", "id", "hash", "row", "n_lines", "n_removed"] and cut.collect()[0]["__gone"] == "some words here"
    assert media.features(media.text_images(empty)).collect() == [] and len(media.features(media.text_images(nulls)).collect()) == 4
    clash = media.text_images(docs).withColumn("tile", media.F.lit("t"))
    assert bytes(media.features(clash).collect()[0].tile[:6]) == b"\x93NUMPY"


def test_queries_keep_their_contracts(spark, sf_dir):
    docs = pairs(documents(spark, sf_dir))
    text = {i: t or "" for i, t in docs}
    start = 0
    for r, i in zip(sorted(queries.op10_token_files(spark, sf_dir).collect(), key=lambda r: r.doc_id), sorted(text), strict=True):
        ids = encoded("word_bpe_49k.json", text[i], 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)
    whole, at = {}, 0
    for r in sorted(queries.op4_packing(spark, sf_dir).collect(), key=lambda r: (r.sequence_id, r.offset)):
        ids = whole.setdefault(r.doc_id, encoded("byte_bpe_50k.json", text[r.doc_id], 1))
        assert r.sequence_id * 2048 + r.offset == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        at += r.length
    assert at == sum(map(len, whole.values())) and set(whole) == set(text)
    for r in queries.op5_media_columns(spark, sf_dir).collect():
        raw = text[r.doc_id].encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes > len(padded) and r.feature
    near = brute.near_duplicates(docs, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op8_minhash_near_dedup(spark, sf_dir).collect()} == {i: (n, c, i == c) for i, (n, c) in near.items()}
    want = brute.repeats(docs, 400)
    for r in queries.op9_suffix_array_dedup(spark, sf_dir).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert r.n_removed or r.text == text[r.doc_id]
