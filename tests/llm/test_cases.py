"""Edge cases and plain versions of the training-data operators."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from echoform.llm import common, cotraining, fingerprints, packing, queries, sharding, toxicity, url_reputation, warc
from tests.llm.test_llm import DATA, DOCS, WORD, empty, labels, nasty


# -- 2: the fingerprint, a byte at a time ------------------------------------------------
def plain_fingerprint(data: bytes) -> str:
    if not data:
        return "1::"
    mask = 0xFFFFFFFF
    powers = [pow(0x9E3779B1, k, 1 << 32) for k in range(1, 8)]
    hashes = []
    for i in range(len(data)):
        h = sum((data[i - k] + 1) * powers[k] for k in range(min(7, i + 1))) & mask
        h ^= h >> 15
        h = h * 0x85EBCA6B & mask
        hashes.append(h ^ h >> 13)

    def ends(block):
        return [i for i, h in enumerate(hashes) if h % block == block - 1]

    def chunks(block):
        return 1 + sum(e < len(data) - 1 for e in ends(block))

    def letters(stops):
        out, start = "", 0
        for stop in [*stops[:63], len(data) - 1]:
            if start <= stop and start < len(data):
                total = sum(hashes[start : stop + 1]) & mask
                out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(total * 0x9E3779B1 & mask) >> 26]
            start = stop + 1
        return out

    block = 1
    while block * 48 < len(data):
        block *= 2
    while block > 1 and chunks(block) < 32:
        block //= 2
    while len(ends(block)) >= 64 and chunks(2 * block) >= 32:
        block *= 2
    step = 1
    while len(ends(block)) >= 64 * step:
        step *= 2
    use = ends(block)[step - 1 :: step]
    wide = ends(2 * block) if step == 1 and chunks(2 * block) >= 16 else ends(block)[2 * step - 1 :: 2 * step]
    return f"{block * step}:{letters(use)}:{letters(wide)}"


def test_fingerprint_equals_a_plain_loop():
    draw = random.Random(5)
    texts = [bytes(draw.choices(range(256), k=draw.randrange(700))) for _ in range(60)] + [b"", b"a", b"ab" * 400, b"line of text\n" * 90, b"\0" * 300]
    for t in texts:
        assert fingerprints.fingerprint(t) == plain_fingerprint(t)


def test_repeated_ids_and_a_lone_document(spark):
    two = [(1, "bb"), (1, "aa"), (None, "cc"), (7, None)]
    got = [(r.doc_id, r.edited_sha256) for r in fingerprints.edit_fingerprints(spark.createDataFrame(two, "doc_id long, text string")).collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(got, key=str) == sorted([(None, sha("ca")), (1, sha("ab")), (1, sha("b")), (7, sha(""))], key=str)
    lone = fingerprints.edit_fingerprints(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).first()
    assert lone.edited_sha256 == sha("abab") and lone.near_next == 1.0


# -- 3 and 10: rows the fit never saw ------------------------------------------------------
def test_quality_on_rows_kept_out_of_the_fit(spark):
    docs, pages, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages", "labels"))
    shown, hidden = known.where("doc_id % 3 > 0"), known.where("doc_id % 3 = 0 and quality is not null")
    got = cotraining.score_documents(docs, pages, shown).join(hidden, "doc_id").select("kept", "quality").collect()
    bad = [r for r in got if r.quality == 0]
    assert len(bad) > 10 and np.mean([not r.kept for r in bad]) >= 0.7
    assert np.mean([r.kept for r in got if r.quality == 1]) >= 0.97


@pytest.mark.parametrize("slack", [2, 16])
def test_lessons_of_a_whole_table_equal_the_plain_form(spark, monkeypatch, slack):
    monkeypatch.setattr(cotraining, "SLACK", slack)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, cotraining.TEXT_DIM)).astype(np.float16)
    x[250:280] = x[100]  # copies, of other metadata
    slots = [sorted({int(s) for s in rng.integers(1, 9, 3)}) for _ in x]
    slots[250:280] = [slots[100]] * 30
    keys = [cotraining.key_of(r.tobytes()) for r in x]
    texts = spark.createDataFrame([(i, keys[i], bytearray(r.tobytes())) for i, r in enumerate(x)] + [(None, 1, bytearray(x[0].tobytes()))], "doc_id long, h long, x binary")
    metas = spark.createDataFrame([(i, keys[i], s) for i, s in enumerate(slots)] + [(None, 1, [1])], "doc_id long, h long, m array<int>")
    used = set(keys[:20])
    whole = cotraining.whole_table(texts, metas, used)
    free = [i for i in range(300) if keys[i] not in used]
    plain = cotraining.in_memory(cotraining._with_one(x[free]), cotraining.meta_features([slots[i] for i in free]), [keys[i] for i in free])
    w = [rng.standard_normal(cotraining.TEXT_DIM + 1) * 0.2, rng.standard_normal(cotraining.META_DIM)]
    taught = 0
    for want in ((30, 40), (9, 200), (300, 300), (5, 5)):
        for (got, ys), (rows, labels) in zip(whole(w, 0.6, want), plain(w, 0.6, want), strict=True):
            assert sorted(map(tuple, np.c_[got, ys])) == sorted(map(tuple, np.c_[rows, labels]))
            taught += len(ys)
    assert taught > 200 and not any(len(ys) for _, ys in whole(w, 0.6, (5, 5)))


def test_toxicity_finds_unseen_rows_and_equals_a_plain_scorer(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.judge(docs, known).join(known.where("toxic is not null"), "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    assert len(toxic) > 5 and np.mean([r.predicted for r in toxic]) >= 0.5
    assert np.mean([r.toxic for r in got if r.predicted]) >= 0.7
    model = toxicity.fit(docs, known)

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row

    def weight(w):
        best = (0.0, 0)
        for e, x in model.lexicon.entries:
            stem = e.rstrip("*")
            d = min(edit(stem, w)) if e.endswith("*") else edit(stem, w)[-1]
            if d <= toxicity.edits(len(stem)) and x * toxicity.FUZZY ** (d > 0) > best[0]:
                best = (x * toxicity.FUZZY ** (d > 0), d)
        return 0.0 if best[1] and w in model.lexicon.clean else best[0]

    seen: dict = {}
    for r in docs.where("length(text) < 1500").limit(150).collect():
        for w in {x.decode() for x in toxicity.words(r.text)}:
            if w not in seen:
                seen[w] = weight(w)
                assert model.lexicon.weight(w.encode()) == pytest.approx(seen[w])


def test_long_words_and_quoted_words():
    lex = toxicity.Lexicon((("moron", 1.0), ("lowei*", 1.0), ("disgusting", 1.0)))
    weigh = lambda w: lex.weight(w.encode())
    assert weigh("lowei" + "x" * 500) == 1 and weigh("liwie" + "o" * 90) == 0.0 and weigh("lowey" + "o" * 90) == toxicity.FUZZY
    assert weigh("moron" + "x" * 100) == weigh("x" * 100 + "moron") == 0
    assert lex.evidence('say "xmorony" now you moron go')[0] == 1.0
    assert lex.evidence('he is a moron, "moron", and MORON')[0] == pytest.approx(2 + toxicity.QUOTED)
    assert lex.evidence("İ été moron «moron» 中文字moron")[0] == pytest.approx(1 + toxicity.QUOTED)
    told = toxicity.Lexicon((("moron", 1.0),), reporting=frozenset({"cited"}))
    assert told.evidence("called him moron")[0] == 1.0 and told.evidence("cited as moron")[0] == toxicity.QUOTED


def test_quality_takes_odd_rows(spark):
    docs, rows = nasty(spark)
    docs = docs.unionByName(spark.createDataFrame([(1, "other text under the same id", None, None, -5)] * 30, DOCS), allowMissingColumns=True)
    pages = spark.createDataFrame([(1, None, None), (None, "http://x", ""), (2, "http://y", "<p>")], "page_id long, url string, html string").withColumn("t", F.lit(1))
    known = labels(spark, [(i, i % 2, 0) for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)] + [(1, None, None), (99, 1, 1)])
    got = cotraining.score_documents(docs, pages, known).collect()
    assert len(got) == len(rows) + 30 and all(0 <= r.score <= 1 for r in got)


# -- 5, 6, 9 ----------------------------------------------------------------------------------
def test_long_payloads_and_reading_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    rows = [(i, f"http://h/{'u' * 9000 if i == 3 else i}", "é" * (400_000 if i == 3 else i)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = common.Scratch(spark, "t").path("w")
    read = warc.read_records(warc.write_archives(pages, root), root)
    assert {r.page_id: len(r.payload) for r in read.collect()} == {i: 2 * len(h) for i, _, h in rows} and read.rdd.getNumPartitions() > 10


def test_long_urls_and_registered_domains(spark):
    hosts = {"a.co.uk:80": ("a.co.uk", "co.uk"), "x.b.co.uk": ("b.co.uk", "co.uk"), "10.0.3.4": ("10.0.3.4", "#"), "[::1]:8": ("[::1]:8", "#"), "com": ("com", "com"), "x.notco.uk": ("notco.uk", "uk"), "": ("", "")}
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *url_reputation.registered(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == hosts
    pages = spark.createDataFrame([(1, "http://example.com/en/7" + "x" * 200_000), (2, "http://" + "a." * 5000 + "com/en/")], "page_id long, url string")
    assert [r.verdict for r in url_reputation.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).orderBy("page_id").collect()] == ["allow", "block"]


def test_shards_keep_extra_columns(spark):
    rows = spark.range(100).select("id", *[F.lit("x").alias(c) for c in ("_src", "_rank", "_key", "_sub", "_from", "shard", "slot", "count")])
    got = sharding.shard_rows(rows, ["id"], 7)
    assert set(got.columns) == set(rows.columns) and got.where("_src = 'x' and _key = 'x' and slot >= 0").count() == 100


# -- 7 and 8 -------------------------------------------------------------------------------------
def test_packing_and_codec_queries_on_odd_rows(spark, tmp_path):
    docs, rows = nasty(spark)
    got = packing.pack_documents(docs.withColumn("bears", F.when(F.col("doc_id") % 2 == 0, True)), WORD, packing.Limits(512, 3, 300), "bears")
    lib = Tokenizer.from_file(WORD)
    want = sum(len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert got.agg(F.sum("length")).first()[0] == want and got.where("doc_id is null").count() >= 1
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum(F.when(F.col("doc_id") % 2 == 0, F.col("length")).otherwise(0)).alias("l"))
    assert per.where("n > 512 or k > 3 or l > 300").count() == 0
    docs.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    byte = Tokenizer.from_file(queries.BYTE_BPE)

    def codec(text):
        ids = byte.encode(text or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return len(ids), sha(",".join(map(str, ids))), sha(byte.decode(ids, skip_special_tokens=False))

    coded = queries.op8_bpe(spark, str(tmp_path)).collect()
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded], key=str) == sorted([(r[0], *codec(r[1])) for r in rows], key=str)


def test_limits_of_the_packing_query_bind(spark):
    pieces = queries.op7_packing(spark, DATA)
    fill = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
    assert fill.where("n > 4096 or k > 48").count() == 0
    short = pa.array(["hi"] * 500)
    tok = packing.Tokenizer(WORD)
    ids, lengths = tok(short)
    packer = packing.Packer(queries.PACK_LIMITS, 0)
    for i, part in enumerate(np.split(ids, np.cumsum(lengths)[:-1])):
        packer.add(i, part.astype("<u4").tobytes(), False)
    packer.flush(True)
    assert max(np.bincount([r[5] for r in packer.rows])) == 48


# -- pipeline and shared folders -------------------------------------------------------------------
def test_stages_keep_rows_apart_and_extra_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a", 10), (1, "quite another text that shares the id but no words", "en", "a", 10), (2, text, "en", "a", 10), (2, text, "en", "a", 10), (3, None, None, None, None), (3, None, None, None, None), (None, text, "en", "a", 1), (None, "a text of its own without any id at all", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine")).withColumn("predicted", F.lit("too"))
    kept = corpus_pipeline.near_copies(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(1, text), (1, rows[1][1]), (3, None), (None, rows[7][1])], key=str)
    clean = corpus_pipeline.toxic(spark, docs, DATA)
    assert clean.columns == docs.columns and {r.score for r in clean.collect()} == {"mine"} and clean.count() >= 6
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), DATA).count() == 0


def test_scratch_is_shared_or_refused(spark, monkeypatch):
    scratch = common.Scratch(spark, "gone")
    table = scratch.write(spark.range(3))
    assert table.count() == 3
    monkeypatch.setattr(common, "_ROOTS", {spark.sparkContext.applicationId: [scratch.root]})
    common.discard(spark)
    with pytest.raises(Exception, match="PATH|exist|FILE"):
        spark.read.parquet(scratch.path("t0")).count()

    class Far:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://far:7077", "applicationId": "x"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Far)
