"""The corpus operators against brute force, round trips and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.llm import decontaminate, html, language, lines, packing, perfect_hash, quality, resemblance, sharding, simhash, token_files, warc
from tallow.llm.common import Scratch
from tallow.llm.encoding import Encoder, default_vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, `key` string"
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
ODD = [
    (1, None, "en", "a", 0, 5, "k"), (2, "", "en", None, 0, 5, None), (3, "\n \t\n", None, "a", 0, 5, "k"), (4, "the same text of this line here, twice", "en", "a", 0, 5, "k"),
    (5, "the same text of this line here, twice", "en", "b", 0, 5, "k"), (5, "the same text of this line here, twice", "en", "b", 0, 5, "k"), (None, "no id at all but a text of some length", "de", "b", 0, 5, "k"),
    (6, LONG, "en", "a", 0, 5, "k"), (7, "1234 $$$ 5678", "en", "a", 0, 5, "k"), (8, "é" * 300, "fr", "a", 0, 5, "k"), (-9, "日本語のテキスト" * 20, "ja", "a", 0, 5, "k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    e, plain = Encoder(default_vocabulary(), memo_words=40), Tokenizer.from_file(default_vocabulary())
    odd = ["Áb J̌. x", "don't STOP... it's, OK's. \x1c a\x1cb c", "", "ΣΑΣ, İx. <|endoftext|>", "a,b.c .,. ,", "1. 2, a1. ²", LONG * 6, "x" * 5000, "hello <|endoftext|> World", "A<|endoftext|>B.<|startoftext|>", "<|ENDOFTEXT|> É a", "<|endof text|>"]
    for text, ids in zip(odd, e.encode_all(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing(spark, odd, empty, docs):
    assert packing.pack_documents(spark, empty).count() == 0
    for rows in (odd, docs):
        got = packing.pack_documents(spark, rows).toPandas()
        assert sorted(got.columns) == sorted(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
        sizes = sorted(got.length, reverse=True)
        free: list[int] = []  # best fit decreasing, document by document
        for n in sizes:
            fits = [g for g in free if g >= n]
            g = min(fits, default=2048)
            if fits:
                free.remove(g)
            free.append(g - n)
        assert got.sequence_id.nunique() == len(free)
    assert (got.length <= 2048).all() and got[got.piece == 0].shape[0] == docs.count()


def test_sharding_is_the_sequential_ring(spark, docs, odd, empty):
    assert sharding.shard_documents(spark, empty).count() == 0
    got = sharding.shard_documents(spark, odd).toPandas()
    assert len(got) == len(ODD)
    got = sharding.shard_documents(spark, docs, shards=7, vnodes=16).toPandas()
    by_shard = got.groupby("shard").slot
    assert all(sorted(s) == list(range(len(s))) for _, s in by_shard) and by_shard.size().max() - by_shard.size().min() <= 1
    cells, nodes = sharding.ring(7, 16)
    keys = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).toPandas()
    room, waiting, placed = sharding.capacities(len(keys), 7, 0.0), [], {}
    for d, h in zip(keys.doc_id, keys.h):
        cell = (h % (1 << 64)) >> (64 - cells.bit_length() + 1)
        arc = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
        waiting.append((arc, h, d))
    waiting.sort()
    for step in range(len(nodes)):
        left = []
        for arc, h, d in waiting:
            s = nodes[(arc + step) % len(nodes)][1]
            if room[s]:
                room[s] -= 1
                placed[d] = s
            else:
                left.append((arc, h, d))
        waiting = left
    assert placed == dict(zip(got.doc_id, got.shard))


def test_a_new_shard_moves_few_keys_where_there_is_slack(spark, docs):
    a, b = (sharding.shard_documents(spark, docs, shards=n, epsilon=0.3).toPandas().set_index("doc_id").shard for n in (10, 11))
    assert (a != b.loc[a.index]).mean() < 0.35


def test_quality_counts(spark, docs, odd, empty):
    assert quality.quality_rules(spark, empty).count() == 0 and quality.quality_rules(spark, odd).count() == len(ODD)
    got = quality.quality_rules(spark, docs).toPandas().set_index("doc_id")
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for d, text in docs.select("doc_id", "text").collect():
        w = word.findall(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        held = [x for x in text.split("\n") if word.search(x)]
        r = got.loc[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(held) - len(set(held)), len(inside))


def test_frequent_lines_deplete(spark):
    body = " ".join(f"own{i}" for i in range(60))
    footer = " ".join(["boiler"] + [f"plate{i}" for i in range(80)])
    rows = [(i, f"{body} {i}\n{footer}", "h") for i in range(30)] + [(100, f"{body} x\n{body.replace('own', 'other')} y\n{footer}", "h"), (101, f"{body} z\n{footer}", "other")]
    got = quality.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id").kept
    assert not got.loc[:29].any() and got.loc[100] and got.loc[101]


def test_decontamination(spark, docs, bench, odd, empty):
    assert decontaminate.contamination(spark, empty, bench).count() == 0 and decontaminate.contamination(spark, odd, bench.limit(0)).filter("contaminated").count() == 0
    extra = spark.createDataFrame([(10_001, "and word3 and"), (10_002, None), (10_003, "!!"), (10_001, "same text of this line")], "item_id long, text string")
    items = bench.select("item_id", "text").union(extra)
    low = lambda s: bytes(b + 32 if 65 <= b <= 90 else b for b in (s or "").encode())
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, text in items.collect():
        w = word.findall(low(text))
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(str(i))
    sizes = {len(k) for k in windows}
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
    got = decontaminate.contamination(spark, rows, items).toPandas().set_index("doc_id")
    for d, text in rows.collect():
        w, hit, ids = word.findall(low(text)), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    ids |= found
        r = got.loc[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    assert decontaminate.decontaminate(spark, odd, bench).columns == odd.columns


def test_several_blocks_find_the_same(spark, docs, bench, monkeypatch):
    one = sorted(map(tuple, decontaminate.contamination(spark, docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 5)
    assert sorted(map(tuple, decontaminate.contamination(spark, docs, bench).collect())) == one


def test_warc_round_trip(spark):
    big = "x" * 2000
    rows = [(1, "http://a/\r\nb c", big), (2, None, big), (3, "u", big), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "u", "é" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert len(got) == 8 and got[3].record_type == "response" and {got[i].refers_to for i in (1, 2, None)} == {3}
    assert got[5].record_type == got[6].record_type == "response" and got[1].payload_bytes == 2000 and got[7].payload_bytes == 1800
    assert got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[4].payload_bytes == 0
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_finds_what_is_sound(packed):
    wrap = warc.member if packed else bytes
    parts = [wrap(warc.record(i, f"u{i}", b"WARC/1.1 not a record " * i, hashlib.sha1(b"WARC/1.1 not a record " * i).hexdigest(), None)) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + b"rubbish" + parts[1] + bytes(broken) + parts[3] + parts[4][: len(parts[4]) // 2] + parts[5] + b"tail"
    found = list(warc.salvage(data))
    ids = [re.search(r"\d+", x[0]["warc-record-id"])[0] for kind, x in found if kind == "record"]
    gaps = [data[x[0] : x[1]] for kind, x in found if kind == "gap"]
    assert ids == ["0", "1", "3", "5"]
    assert gaps[0] == b"rubbish" and gaps[1] == bytes(broken) and gaps[-1] == b"tail"


def test_token_files(spark, odd, empty, tmp_path):
    assert token_files.write_and_read(spark, empty).count() == 0
    tokens = Encoder(default_vocabulary())
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.doc_id, r.text) for r in odd.collect())
    start, expected = 0, []
    for _, d, text in rows:
        ids = tokens.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.write_and_read(spark, odd, partitions=4).orderBy("start").collect()]
    assert got == expected
    folder = str(tmp_path)
    (manifest,) = token_files.write_shards(odd, folder, default_vocabulary(), 1, 1).collect()
    shard = token_files.Shard(folder, manifest.file)
    assert len(shard.ids(5)) == 2 and shard.ids(12345) == [] and shard.ids(-9)[0][-1] == 1


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 62, 20_000, replace=False).astype(np.int64)
    table = perfect_hash.PerfectHash.from_bytes(perfect_hash.PerfectHash.build(keys).to_bytes())
    assert sorted(table.lookup(keys)) == list(range(len(keys)))


def test_simhash(spark, docs, odd, empty):
    import xxhash

    assert simhash.near_duplicates(spark, empty).count() == 0
    rows = docs.select("doc_id", "text").union(odd.select(F.col("doc_id") + 100_000, "text"))
    got = simhash.near_duplicate_digest(spark, rows).toPandas()
    assert len(got) == rows.count()
    texts = {}
    for d, text in rows.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        texts.setdefault(d, f"{sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)):016x}")
    plain = got[got.doc_id.notna()]
    assert all(texts[int(d)] == f for d, f in zip(plain.doc_id, plain.fingerprint))
    codes = np.unique(np.array([int(f, 16) for f in got.fingerprint], dtype=np.uint64))
    i, j = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)
    labels = simhash.unite(np.arange(len(codes)), i, j)
    got["c"] = labels[np.searchsorted(codes, np.array([int(f, 16) for f in got.fingerprint], dtype=np.uint64))]
    assert (got.groupby("c").doc_id.transform("min").fillna(-1) == got.component_id.fillna(-1)).all()
    odd_kept = simhash.keep_one(spark, odd.select("doc_id", "text")).toPandas()
    assert odd_kept.doc_id.dropna().is_unique


def test_gray_index_equals_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(10):
        codes = [int(x) for x in rng.integers(0, 1 << 62, 4)]
        for _ in range(rng.integers(20, 500)):
            c = codes[rng.integers(len(codes))]
            for _ in range(rng.integers(1, 6)):
                c ^= 1 << int(rng.integers(64))
            codes.append(c)
        codes = np.unique(np.array(codes, dtype=np.uint64))
        rank = codes.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        codes = codes[np.argsort(rank)]
        i, j = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)
        assert (simhash.GrayIndex(codes, 3).forest() == simhash.unite(np.arange(len(codes)), i, j)).all()


def test_lines(spark, docs, odd, empty):
    assert lines.line_classes(spark, empty).count() == 0 and lines.dedup_lines(spark, empty).count() == 0
    base = "the quick brown fox jumps over the lazy dog and then runs along the river bank until the evening comes over all the hills"
    near = base.replace("evening", "morning")
    rows = [(1, f"{base}\nshort"), (2, f"own line of the second document, unlike others\n{near}\nshort"), (3, base.upper() + "  "), (4, None), (5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone2", F.lit(1))
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark, table).collect()}
    assert got == {1: f"{base}\nshort", 2: "own line of the second document, unlike others\nshort", 4: None, 5: ""}
    assert lines.dedup_lines(spark, odd).columns == odd.columns
    found = lines.line_classes(spark, docs, exhaustive=True).filter("line_hash IS NOT NULL").toPandas()
    texts = lines.distinct_lines(docs, lines.MIN_CHARS).select("h", lines.normalised(F.col("line")).alias("x")).collect()
    sets = {r.h: {r.x[i : i + 8] for i in range(max(1, len(r.x) - 7))} for r in texts}
    hashes = sorted(sets)
    index = defaultdict(list)
    at = {h: i for i, h in enumerate(hashes)}
    for h, s in sets.items():
        for g in s:
            index[g].append(h)
    left, right = [], []
    for h, s in sets.items():
        for k, n in Counter(k for g in s for k in index[g] if k > h).items():
            if n >= 0.8 * (len(s) + len(sets[k]) - n):
                left.append(at[h])
                right.append(at[k])
    labels = simhash.unite(np.arange(len(hashes)), np.array(left, dtype=int), np.array(right, dtype=int))
    mine = dict(zip(found.line_hash, found.component))
    linked = sum(mine[hashes[a]] == mine[hashes[b]] for a, b in zip(left, right))
    assert linked == len(left) and all(labels[at[h]] == labels[at[c]] for h, c in mine.items())
    assert (found.groupby("component").kept.sum() == 1).all()
    usual = lines.line_classes(spark, docs).filter("line_hash IS NOT NULL").toPandas()
    mine = dict(zip(usual.line_hash, usual.component))
    assert sum(mine[hashes[a]] == mine[hashes[b]] for a, b in zip(left, right)) >= 0.999 * len(left)


def test_language(spark, docs, odd, empty):
    got = language.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97 and got.score.between(0, 1).all() and got.rejected.mean() < 0.02
    model = language.fit_documents(docs)
    predicted, names = language.predict(spark, odd, model)
    rows = {r.doc_id: r for r in predicted.collect()}
    assert rows[1]._lang == rows[2]._lang == rows[7]._lang == "und" and rows[7]._rejected and len(rows) == 10 and names == ["_lang", "_score", "_rejected"]
    assert language.identify(spark, empty).count() == 0
    assert all(r.lang_pred == "und" for r in language.identify(spark, odd.withColumn("lang", F.lit(None).cast("string"))).collect())
    whole, parts = language.counts(LONG), language.SLICE
    language.SLICE = 1000
    try:
        assert (language.counts(LONG) == whole).all()
    finally:
        language.SLICE = parts


def test_html():
    page = """<html><head><title>t</title><script>var a="</p><p>no";</script></head><body><!-- <p>no --><nav><a href="/">Menu</a></nav>
    <article><h1>Head &amp; line</h1><p>One<br>two &#8212; <b>three</b> <a href="x">four</a><p>Five   six</p><div class="share">Share</div>
    <section id="comments"><p>A reader says so and so and so.</p></section></article><aside>Side</aside><footer>&copy; foot</footer></body></html>"""
    assert html.main_text(page) == "Head & line\n\nOne two — three four\n\nFive six"
    assert html.main_text(None) == html.main_text("") == html.main_text("<!-- open <p>x") == ""
    text = "It was the best of times and it was the worst of times, and we had all of it before us as we were going to the place that was ours. " * 3
    plain = f"<body><ul><li><a href=1>Home</a></li></ul><p>{text}</p><h2>Short</h2><p>{text}</p><p>Buy now</p></body>"
    assert html.main_text(plain) == f"{text.strip()}\n\nShort\n\n{text.strip()}"


def test_html_articles(spark):
    from html import unescape

    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        inner = re.sub(r"<[^>]*>", " ", re.sub(r"</?(p|h1)[^>]*>", "\0", inner))
        assert html.main_text(page.html) == "\n\n".join(x for x in (" ".join(unescape(y).split()) for y in inner.split("\0")) if x)


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert len(rows) and (rows.groupby("sequence_id").length.sum() <= 2048).all() and rows.doc_id.nunique() > 100


def test_random_texts_survive(spark):
    rng = random.Random(5)
    rows = [(i, "".join(chr(rng.choice([10, 32, 46, 65, 97, 233, 769, 0x1F600, 0])) for _ in range(rng.randint(0, 80))), "en", "s") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert quality.quality_rules(spark, table).count() == simhash.near_duplicates(spark, table).count() == 60
    assert packing.pack_documents(spark, table).select("doc_id").distinct().count() == language.identify(spark, table).count() == 60


def test_lines_of_rows_that_share_an_id(spark):
    shared = "a line that a good many of the documents have in common"
    rows = [(1, shared), (5, f"{shared}\nmore of it"), (5, "a unique first line of another text, same id"), (None, shared), (None, "a unique line of a row that has no id at all"), (None, f"{shared}\nsecond row")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter(line for r in lines.dedup_lines(spark, table).collect() for line in r.text.split("\n"))
    assert left == Counter({line for _, text in rows for line in text.split("\n")})


def test_lines_that_share_word_starts_only_are_unlike(spark):
    texts = [
        "https://one.example.org/a/page", "https://quite-another.example.net/b/c/d", "internationalization-of-coffee", "internationalism-and-the-state-of-play",
        "ພາສາລາວເປັນພາສາທາງການຂອງປະເທດ", "ພາສາລາວເປັກອກຂຂຄຄງງຈຈສສຊຊຍຍດດຕຕ", "abcdefgh-0123456789ABCDEF x", "abcdefgh-zyxwvutsrqponmlk y",
    ]
    long = "https://example.org/" + "".join(random.Random(1).choice("abcdefgh0123") for _ in range(200))
    table = spark.createDataFrame(list(enumerate([*texts, long, "x" + long[:-3]])), "doc_id long, text string")
    assert sorted(r.text for r in lines.dedup_lines(spark, table).collect()) == sorted([*texts, long])


def test_keep_one_of_rows_that_share_an_id(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    rows = [(None, words[0]), (None, words[1]), (None, words[2]), (7, words[3]), (7, words[4]), (7, words[4]), (8, words[4]), (9, words[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(spark, table).collect())
    assert got == Counter([(9, words[0]), (None, words[1]), (None, words[2]), (7, words[3]), (7, words[4])])


def test_html_elements_left_open():
    for head in ("<head><title>x</title>", "<head><title>x</title><meta charset=utf-8><script>a</script>"):
        assert html.main_text(f"<html>{head}<body><article><p>Real text") == html.main_text(f"<html>{head}<article><p>Real text") == "Real text"
    for tag in ("button", "select", "object", "noscript", "template", "svg", "canvas", "math"):
        assert html.main_text(f"<article><p>One<{tag}>no<p>Two</p><p>Three</article>") == "One\n\nTwo\n\nThree"
        assert html.main_text(f"<article><p>One<{tag}>no<{tag}>no</{tag}><p>Two</p></article>") == "One\n\nTwo"
        assert html.main_text(f"<article><p>One <{tag}><p>no</p><b>no</b></{tag}>two</article>") == "One two"
    assert html.main_text("<article><p>One <svg><title/><style/></svg>two</article>") == "One two"


def test_near_dedup_equals_all_pairs(spark, docs):
    rng = random.Random(3)
    family = [f"common{j}" for j in range(100)]
    rows = [(-i, " ".join([*family[: rng.randrange(60, 100)], *(f"own{i}w{j}" for j in range(rng.randrange(40)))])) for i in range(1, 200)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in table.collect()]
    sets = [set(np.concatenate([np.zeros(0, np.uint64), *simhash.shingle_hashes((t or "").encode(), 5)]).tolist()) for _, t in texts]
    index = defaultdict(list)
    left, right = [], []
    for i, s in enumerate(sets):
        for k, n in Counter(k for g in s for k in index[g]).items():
            if 5 * n >= 4 * (len(s) + len(sets[k]) - n):
                left.append(k)
                right.append(i)
        for g in s:
            index[g].append(i)
    labels = simhash.unite(np.arange(len(sets)), np.array(left, dtype=int), np.array(right, dtype=int))
    least = defaultdict(list)
    for (d, _), c in zip(texts, labels):
        least[c].append(d)
    table = table.withColumns({c: F.lit(1) for c in ("kept", "key", "text_key")})
    kept = simhash.keep_one(spark, table, exhaustive=True)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(map(min, least.values()))
    assert abs(simhash.keep_one(spark, table).count() - len(least)) <= 1
    assert simhash.keep_one(spark, table.limit(0)).count() == 0


def test_salvage_reads_foreign_and_long_headers(spark):
    import base64

    block = b"some page"
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    old = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n b\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    long = warc.record(1, "http://a/" + "x" * 200_000, block, hashlib.sha1(block).hexdigest(), None)
    for data in (old + long + old, warc.member(old) + warc.member(long) + warc.member(old)):
        assert [(kind, x[1]) for kind, x in warc.salvage(data)] == [("record", block)] * 3
    damaged = old.replace(b"\r\n\r\n", b"\r\n", 1)
    assert [kind for kind, _ in warc.salvage(damaged + long)] == ["gap", "record"]
    pages = spark.createDataFrame([(1, "http://a/" + "x" * 70_000, "page")], "page_id long, url string, html string")
    assert warc.round_trip(spark, pages).count() == 1


def test_letters_of_all_planes():
    assert language.counts(chr(0x30010) * 5) is not None and language.counts("12 \U0001F600") is None


def test_columns_of_any_name_pass(spark, bench):
    own = "a sentence of this document that is long enough to be told by its language and by nothing else"
    rows = spark.createDataFrame([(i, f"{own} {i}\n{own}", "en") for i in range(6)], "doc_id long, text string, lang string")
    names = ["_text", "_lang", "_score", "_rejected", "_items", "_n_hit", "_n_words", "_gone", "_left", "gone", "left", "doc", "row", "h", "kept", "key", "text_key", "root", "node", "a", "b"]
    rows = rows.withColumns({n: F.col("doc_id").cast("string") for n in names})
    for kept in (language.keep_identified(spark, rows), lines.dedup_lines(spark, rows), simhash.keep_one(spark, rows), decontaminate.decontaminate(spark, rows, bench)):
        assert kept.columns == rows.columns and all(r[n] == str(r.doc_id) for r in kept.collect() for n in names)
    assert packing.pack_documents(spark, rows).count() == sharding.shard_documents(spark, rows).count() == token_files.write_and_read(spark, rows).count() == 6
    assert quality.quality_rules(spark, rows, host="lang").count() == 6


def test_quality_of_repeated_rows(spark):
    body, footer = " ".join(f"own{i}" for i in range(60)), " ".join(f"plate{i}" for i in range(25))
    rows = [(i, " ".join(f"x{i}y{j}" for j in range(60)) + f"\n{footer}", "h") for i in range(30)]
    rows += [(100, f"{body}\n{footer}", "h")] * 3 + [(None, f"{body} {i}\n{footer}", "h") for i in range(3)]
    got = quality.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == len(rows) and got.kept.all() and set(got.removed_words) == {25}


def test_gaps_are_logged_and_the_rest_is_returned(spark, tmp_path, monkeypatch):
    whole = warc.member
    monkeypatch.setattr(warc, "member", lambda data: b"damage" + whole(data))
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    folder = warc.make_folder("file://" + str(tmp_path / "archives"))
    manifest = warc.write_archives(warc.with_references(pages), folder)
    back = warc.read_archives(manifest, folder, 1).collect()
    assert sorted(r.page_id for r in back if r.page_id is not None) == list(range(5)) and sum(r.gap_end - r.gap_start for r in back if r.reason) == 30


@pytest.mark.parametrize("block", [1024, 32])
def test_no_pair_of_a_bucket_is_lost(spark, monkeypatch, block):
    """Pairs of similar sets, and a large group, in one bucket full of sets that are alike and yet under 0.8."""
    monkeypatch.setattr(resemblance, "BLOCK", block)
    rng = random.Random(11)
    word = lambda: rng.getrandbits(64) - (1 << 63)
    family = [word() for _ in range(72)]
    rows, expected = [], []
    for size in [2] * 130 + [60]:
        own = [word() for _ in range(28)]
        group = [rng.getrandbits(48) for _ in range(size)]
        rows += [(h, [*family, *own, *(word() for _ in range(9))]) for h in group]
        expected += [(h, min(group)) for h in group]
    sides = spark.createDataFrame([(h, s, len(s)) for h, s in rows], "h long, side array<long>, n int")
    signed = spark.createDataFrame([(h, [5, 6]) for h, _ in rows], "h long, keys array<long>")
    roots = resemblance.groups(spark, signed, lambda wanted: sides.join(wanted, "h"), lambda side: side, Scratch(spark, "family"))
    assert sorted((r.node, r.root) for r in roots.collect()) == sorted(expected)


def test_dealt_minima_find_the_pairs(spark):
    rng, rows, pairs = random.Random(7), [], 300
    for i in range(pairs):
        union = 100 + i % 150
        hashes = [rng.getrandbits(31) for _ in range(union)]
        own = union // 5
        for side, left_out in enumerate((hashes[: own // 2], hashes[own // 2 : own])):
            rows += [(2 * i + side, x, True) for x in hashes if x not in left_out]
    sets = spark.createDataFrame(rows, "h long, x long, alone boolean")
    keys = resemblance.dealt_keys(sets).select("h", F.explode("keys").alias("key")).toPandas().groupby("h")["key"].agg(set)
    assert all(len(k) == resemblance.PARTS // resemblance.ROWS * resemblance.EACH for k in keys)
    assert sum(not keys[2 * i] & keys[2 * i + 1] for i in range(pairs)) <= 1
    assert sum(bool(keys[2 * i] & keys[2 * i + 2]) for i in range(pairs - 1)) == 0
    # a hash meets EACH factors, not BANDS * ROWS
    plan = resemblance.dealt_keys(sets)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min(") == resemblance.EACH


def test_long_lines_of_few_shingles_meet_short_ones(spark):
    texts = ["ab" * 15, "ab" * 300, "wide and " * 6, "wide and " * 70, "".join(chr(0x4E00 + i) for i in range(95)), "".join(chr(0x4E00 + i) for i in range(90)) * 9]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.doc_id: r.component for r in lines.line_classes(spark, table).collect()}
    assert roots[0] == roots[1] and roots[2] == roots[3] and roots[4] == roots[5] and len(set(roots.values())) == 3
