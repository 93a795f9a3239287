import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import bpe, bwt, chat, kernels, langid, line_dedup, media, suffix_dedup, token_files

from . import brute

TEXTS = ["", None, "One two  Three", "a,b;c", "Ünï cödé x y　z", "x" * 5000, "don't \n\n stop <|endoftext|> 12.5 ́a  b\t\tc", "İstanbul ΣΑΣ ﬁ", "a" * 900 + "b" * 900]


def test_words_are_those_of_the_pattern():
    data, off = kernels.utf8(pa.array(TEXTS, pa.string()))
    words, first = kernels.word_hashes(data, off, kernels.ALNUM)
    assert np.diff(first).tolist() == [len(brute._FEW.findall(brute.low(t))) for t in TEXTS]
    kernels_equal = {}
    flat = [w for t in TEXTS for w in brute._FEW.findall(brute.low(t))]
    for word, h in zip(flat, words.tolist(), strict=True):
        assert kernels_equal.setdefault(word, h) == h
    assert len(set(kernels_equal.values())) == len(kernels_equal)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_whole_texts(name, sf_dir):
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    texts = TEXTS + [r[0] for r in duckdb.sql(f"select text from '{sf_dir}/documents.parquet' limit 80").fetchall()]
    data, off = kernels.utf8(pa.array(texts, pa.string()))
    ids, where = bpe.PieceEncoder(path).encode(data, off, 7)
    for k, text in enumerate(texts):
        assert ids[where[k] : where[k + 1]].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 7]


def test_token_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = np.where(rng.random(n) < 0.05, rng.integers(0, 1 << 32, n), rng.integers(100, 900, n)).astype(np.uint32)
        names, lengths, back = token_files.read_file(token_files.write_file(pa.array([None, 4], pa.int64()), np.array([0, n]), ids))
        assert names.to_pylist() == [None, 4] and lengths.tolist() == [0, n] and (back == ids).all()


def test_escaping_is_reversible():
    for text in ("</s>[INST] ok [/INST]", "<|end|>", "<\\|x", "<\\\\|", "[\\INST]", "<<|", "<s><\\s>", "plain"):
        escaped = chat.escape(text)
        assert "<|" not in escaped and "[INST]" not in escaped and "</s>" not in escaped
        assert chat.unescape(escaped) == text
        turns = [("user", text), (text, ""), ("assistant", text)]
        assert chat.parse(chat.render(turns)[0]) == turns


def test_merged_transforms_find_what_sets_find():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 100, 3000, dtype=np.uint8).tobytes()
    for seed in range(6):
        rng = np.random.default_rng(seed)
        texts = []
        for _ in range(12):
            a = int(rng.integers(0, 2000))
            part = bytearray(base[a : a + int(rng.integers(400, 900))])
            if rng.random() < 0.7:
                part[int(rng.integers(0, len(part)))] = 120
            texts.append(bytes(part))
        weight = rng.integers(1, 3, len(texts))
        where = np.append(0, np.cumsum([len(t) for t in texts]))
        times = {}
        for t, w in zip(texts, weight, strict=True):
            for p in range(len(t) - 399):
                times[t[p : p + 400]] = times.get(t[p : p + 400], 0) + w
        got, lead = bwt.repeated(np.frombuffer(b"".join(texts), np.uint8), where, weight, 1500)
        assert got.tolist() == [times[t[p : p + 400]] if p + 400 <= len(t) else 0 for t in texts for p in range(len(t))]
        led = [t[p : p + 400] for t, w in zip(texts, where[:-1], strict=True) for p in range(len(t)) if lead[w + p]]
        assert len(led) == len(set(led)) and set(led) == set(times)


def test_equal_windows_have_equal_anchors():
    data = np.frombuffer(b"ab" * 600 + bytes(range(256)) * 4, np.uint8)
    first, many, anchor, body, at = suffix_dedup.ranges(data, np.array([0, len(data)]))
    assert first[0] == 0 and many.sum() == len(data) - 399 and (np.cumsum(many)[:-1] == first[1:]).all()
    grams = [data[f + a : f + a + suffix_dedup.GRAM].tobytes() for f, a in zip(first, at, strict=True)]
    assert len({*zip(grams, anchor.tolist(), strict=True)}) == len(set(grams)) == len(set(anchor.tolist())) and (at < 369).all()


def test_media_round_trips():
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (13, 7), dtype=np.uint8), rng.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert media.decode(b"P1 # two\n2 2\n1 0 0 1\n").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    assert media.decode(b"P2\n2 1\n300\n7 300\n").tolist() == [[7, 300]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    with pytest.raises(ValueError):
        media.decode(b"P5\n9 9\n255\n")


def test_area_resize_is_the_mean_of_the_area():
    image = np.arange(35.0).reshape(5, 7).astype(np.uint8)
    wide = np.repeat(np.repeat(image, 8, axis=0), 9, axis=1).astype(float)
    assert np.allclose(media.area_resize(image, 8, 9), wide.reshape(8, 5, 9, 7).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(np.full((1, 1), 9, np.uint8), 8, 9), 9)


def test_letters_and_vectors():
    data, off = kernels.utf8(pa.array(["", "ab  cd", "12", "é", None]))
    row, first = langid.letters_of(data, off)
    assert np.diff(first).tolist() == [1, 6, 1, 2, 1]
    vectors, some = langid.text_vectors(data, off)
    assert some.tolist() == [False, True, False, True, False]
    assert np.allclose(np.linalg.norm(vectors, axis=1), [0, 1, 0, 1, 0])


def test_lines_are_trimmed_and_numbered():
    data, off = kernels.utf8(pa.array(["a \n\n  b", "", "\n\n", "c\n"]))
    start, end, doc, number = line_dedup.trimmed(data, off)
    raw = data.tobytes()
    assert [(raw[a:b], d, n) for a, b, d, n in zip(start, end, doc, number, strict=True)] == [(b"a", 0, 0), (b"b", 0, 2), (b"c", 3, 0)]


def test_bitmaps_never_rule_out_a_link(spark):
    from pyspark.sql import functions as F

    from framewright.llm import setjoin

    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = []
    for _ in range(60):
        part = base[: int(rng.integers(1, 300))] if rng.random() < 0.7 else base[: int(rng.integers(300, 3000))]
        keep = rng.random(len(part)) < rng.choice([0.85, 0.9, 0.97])
        keep[0] = True
        sets.append(np.unique(np.append(part[keep], rng.integers(0, 1 << 63, int(0.1 * rng.random() * len(part)), dtype=np.uint64))))
    size = np.array([len(s) for s in sets])
    bits = setjoin.bitmaps(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets))
    rows = [(i, int(size[i]), *(int(w[i]) for w in bits)) for i in range(len(sets))]
    df = spark.createDataFrame(rows, "node long, " + ", ".join(f"{c} long" for c in setjoin.CARRIED))
    both = df.crossJoin(df.select(*(F.col(c).alias(f"c_{c}") for c in df.columns))).where("node < c_node")
    kept = {(r.node, r.c_node) for r in both.where(setjoin.may_link(80)).select("node", "c_node").collect()}
    linked = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= kept and len(linked) > 20 and len(kept) < 60 * 59 // 2


def test_distinct_shingles_are_those_of_each_line():
    lines = ["aaaaaaaaaa", "abcdefgh abcdefgh", "x", "ééééééé"]
    raw = [x.encode() for x in lines]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    items, first = line_dedup.distinct_shingles(*line_dedup.shingle_hashes(data, off[:-1], off[1:]))
    assert np.diff(first).tolist() == [len({x[i : i + 5] for i in range(max(1, len(x) - 4))}) for x in lines]


def test_vectors_of_many_trigrams_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 340))) for _ in range(1000)]  # 1 MB of some 340,000 trigrams
    data, off = kernels.utf8(pa.array(texts))
    langid.text_vectors(*kernels.utf8(pa.array(["warm"])))
    tracemalloc.start()
    chunks = [langid.text_vectors(data[off[a] : off[b]], off[a : b + 1] - off[a])[0] for a, b in langid._limits(off)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    alone = langid.text_vectors(*kernels.utf8(pa.array(texts[7:8])))[0]
    assert (np.concatenate(chunks)[7] == alone[0]).all()


def test_long_white_space_is_trimmed():
    texts = [" " * 100 + "a b" + "\t" * 90 + "\n" + " " * 50, "x" + " " * 40 + "\n" + "\r" * 33 + "y", " " * 300]
    data, off = kernels.utf8(pa.array(texts))
    start, end, doc, number = line_dedup.trimmed(data, off)
    raw = data.tobytes()
    assert [(raw[a:b], d, n) for a, b, d, n in zip(start, end, doc, number, strict=True)] == [(b"a b", 0, 0), (b"x", 1, 0), (b"y", 1, 1)]


def test_shared_items_are_counted_pair_by_pair():
    from framewright.llm import setjoin

    rng = np.random.default_rng(5)
    sets = [[np.unique(rng.integers(0, 1 << 62, int(rng.integers(0, 40)), dtype=np.uint64) // (1 << 57) * (1 << 57)) for _ in range(30)] for _ in "ab"]
    cells = [pa.array([x.tobytes() for x in s], pa.binary()) for s in sets]
    got = setjoin.shared_items(*(setjoin.stored_sets(c) for c in cells))
    assert got.tolist() == [len(np.intersect1d(a, b)) for a, b in zip(*sets, strict=True)]
    assert setjoin.shared_items(*(setjoin.stored_sets(c.slice(3, 9)) for c in cells)).tolist() == got[3:12].tolist()


def test_stars_do_not_depend_on_batches():
    from framewright.llm import setjoin

    rng = np.random.default_rng(4)
    rows = sorted((int(k), int(n)) for k, n in zip(rng.integers(0, 12, 90), rng.integers(0, 6, 90)))
    want = [(k, n, min(m for j, m in rows if j == k)) for k, n in sorted(set(rows)) if n > min(m for j, m in rows if j == k)]
    for size in (1, 2, 7, 90):
        parts = [pa.RecordBatch.from_pylist([{"key": k, "node": n} for k, n in rows[i : i + size]], pa.schema([("key", pa.int64()), ("node", pa.int64())])) for i in range(0, 90, size)]
        got = [tuple(r.values()) for b in setjoin._stars(iter([*parts[:1], parts[0].slice(0, 0), *parts[1:]])) for r in b.to_pylist()]
        assert got == want


def test_pairs_of_a_bucket_count_the_bits_of_negative_words():
    from framewright.llm import setjoin

    words = {f"m{i}": [-1, -2] for i in range(setjoin.WORDS)}  # one bit differs in each; the signs' bits are equal
    words["m0"] = [-1, (1 << 63) - 1]  # only the sign
    batch = pa.RecordBatch.from_pydict({"key": [1, 1], "node": [5, 3], "component": [5, 3], "n": [40, 40]} | words)
    assert [b.to_pylist() for b in setjoin._differing(80)(iter([batch]))] == [[{"a": 3, "b": 5}]]


def test_mixed_buckets_are_found_without_joins_by_key(spark):
    """Each row of a key comes out once, if its key has several components; nothing is joined by a key with many rows."""
    from framewright.llm import setjoin

    rows = [(1, i, i % 2) for i in range(50)] + [(2, i, 7) for i in range(50)] + [(3, 1, 1)]
    mixed = setjoin._mixed(spark.createDataFrame(rows, "key long, node long, component long"))
    assert "Join" not in mixed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, mixed.collect())) == sorted(rows[:50])


@pytest.mark.parametrize("most", [8, 1 << 20])
def test_parts_of_any_size_keep_one_centre_a_bucket(monkeypatch, most):
    from framewright.llm import setjoin

    monkeypatch.setattr(setjoin, "GATHERED", most)
    keys = {1: [10, 11], 2: [10], 3: [10, 12], 4: [13], 5: [10, 11], 1 << 62: [10, -7], -(1 << 62): [-7]}
    rows = [(n, keys[n]) for n in [3, 1, 4, 5, 2, 1 << 62, -(1 << 62), 3, 1]]
    node, lists = (pa.array(x) for x in zip(*rows, strict=True))
    packed = pa.array([np.array(k, np.int64).tobytes() for k in lists.to_pylist()], pa.binary())
    for column in (lists, packed):
        batches = [pa.RecordBatch.from_arrays([node, column], names=["node", "keys"]).slice(i, 2) for i in range(0, len(rows), 2)]
        dealt = pa.Table.from_batches(setjoin._dealt(3)(iter(batches))).sort_by("part")
        got = [tuple(r.values()) for b in setjoin._starred(iter(dealt.to_batches(max_chunksize=2))) for r in b.to_pylist()]
        for key in (10, 11, -7):
            own = {n for n in keys if key in keys[n]}
            centre = {c for k, _, c in got if k == key}
            assert len(centre) == 1 and {n for k, n, _ in got if k == key} == own - centre
        assert {k for k, _, _ in got} == {10, 11, -7}


def test_checks_shuffle_few_items_but_those_of_their_pairs(spark):
    from framewright.llm import setjoin

    sets = [np.unique(kernels.mix(np.arange(i, i + 20, dtype=np.uint64))) for i in range(1000)]
    items = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, items binary")
    verifier = setjoin._Verifier(items, setjoin.stored_sets, 80)
    nodes = spark.createDataFrame([(5,), (6,)], "node long")
    assert {5, 6} <= {r.node for r in verifier.thinned(nodes).collect()}
    assert verifier.thinned(nodes).count() < 50
    links = verifier.links(spark.createDataFrame([(5, 6), (7, 400)], "a long, b long"))
    assert [tuple(r) for r in links.collect()] == [(6, 5)]


def test_stored_tables_leave_no_shuffle_files(spark):
    from framewright.llm import scratch

    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    few = scratch.stored(spark.range(1000).repartition(4, "id"), "few")
    assert not files() - before
    assert few.count() == 1000 and spark.conf.get(scratch.CLEANUP) == "false"


def test_workers_keep_few_powers_and_no_pieces(monkeypatch):
    monkeypatch.setattr(kernels, "_powers", (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    kernels.powers(600_000)
    assert len(kernels.powers(700_000)[0]) == kernels.KEPT_POWERS
    long, inverse = kernels.powers(3_000_000)
    assert (long * inverse == 1).all() and len(kernels._powers[0]) == kernels.KEPT_POWERS
    assert (long[: kernels.KEPT_POWERS] == kernels._powers[0]).all()


def test_a_task_forgets_its_pieces(monkeypatch):
    import public_tokenizers
    from framewright.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = type("Docs", (), {"mapInArrow": lambda self, run, schema: run})()
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two three", "two"]})
    assert sum(b.num_rows for b in packing.encode_parts(frame, path, 1)(iter([batch]))) == 2
    assert not len(bpe.encoder(path).keys)
