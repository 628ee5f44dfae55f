"""The corpus operators against brute force, exact round trips and held-out accuracy, and on awkward rows."""

import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import common, jaccard_join, langid, licenses, media, mixing, neighbours, packing, rans, sharding, token_files, tokens, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, r string"
ROWS = [
    (1, "Released under the MIT License. " + "alpha beta gamma delta epsilon zeta " * 30, "en", "a", 1, 1, 1.0, "x"),
    (2, "Released under the MIT License. " + "alpha beta gamma delta epsilon zeta " * 30, "en", "a", 1, 1, 1.0, "x"),
    (2, "Released under the MIT License. " + "alpha beta gamma delta epsilon zeta " * 30, "en", "a", 1, 1, 1.0, "x"),
    (3, None, None, None, None, None, None, None),
    (4, "", "de", "b", 0, 0, 0.0, ""),
    (None, "der die das und ein nicht mit ist", "de", None, None, None, None, None),
    (5, "one two", "en", "b", None, None, None, None),
    (6, "ONE two", None, "b", None, None, None, None),
    (7, " \n\t ", "en", "c", None, None, None, None),
    (8, "Größe " * 6000, "de", "c", None, None, None, None),
    (9, "\U0001F600 123 ... \x1c x", "en", "c", None, None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    common.prepare(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    common.prepare(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder of the awkward rows, and one without rows."""
    out = {}
    for name, rows in (("awkward", ROWS), ("empty", [])):
        d = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 1), (2, 0, None), (None, 1, 1)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        vectors = [(i, [float(i % 7), 1.0, -2.0], 1) for i in range(45)] + [(50, None, 1), (51, [0.0, 0.0, 0.0], 1), (52, [1.0, None, 2.0], 1), (53, [float("nan"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1)]
        spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
        said = [(1, 0, "user", "Hi."), (1, None, None, None), (2, 3, "assistant", ""), (None, 1, "user", "x" * 100_000), (2, 3, "assistant", "")]
        spark.createDataFrame([(*r, 1) for r in said] if rows else [], "conv_id long, turn long, role string, text string, cost int").write.parquet(f"{d}/conversations.parquet")
        out[name] = d
    return out


def test_queries_on_awkward_and_empty_tables(spark, folder):
    from plumbline.llm.queries import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, folder["empty"]).count() == 0, name
        n = query(spark, folder["awkward"]).count()
        assert n == {"op7_best_fit_packing": n, "op8_learned_partitions": 60, "op12_conversation_repair": 3, "op13_filter_interactions": 4 * 600}.get(name, len(ROWS)), name
    assert corpus_pipeline.run(spark, folder["empty"]).count() == 0
    assert corpus_pipeline.run(spark, folder["awkward"]).count() > 0


def test_media_round_trip(spark):
    rows = {r.doc_id: r for r in media.op1_media_sequences(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = (r.text or "").encode()
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        got = rows[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(raw), len(want), sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert got.caption == f"document {r.doc_id}"


def test_sequences_keep_order_and_captions():
    html = '<p>a &amp; b</p><script>no</script><figure><img src="sha256:1f" alt="x"><figcaption>cap</figcaption></figure><p>c<img src="u.png" alt="y">d'
    assert [(i["kind"], i["text"], i["digest"], i["caption"]) for i in media.sequence(html)] == [("text", "a & b", None, None), ("media", None, "1f", "cap"), ("text", "c", None, None), ("media", None, "u.png", "y"), ("text", "d", None, None)]
    assert media.sequence(None) == [] and [i["position"] for i in media.sequence(html)] == list(range(5))


@pytest.mark.parametrize(
    "html, want",
    [
        ('<figure><img src="u"><figcaption>cap</figure><p>after</p>', [("media", None, "cap"), ("text", "after", None)]),
        ('<div><img src="u"><figcaption>cap</div>after', [("media", None, "cap"), ("text", "after", None)]),
        ('<figure><img src="u"><figcaption><p>one</p><p>two</p> three</figcaption></figure>d', [("media", None, "one two three"), ("text", "d", None)]),
        ('<figure><img src="u"><figcaption>cap<figure><img src="v"></figure>', [("media", None, "cap"), ("media", None, None)]),
        ('<figure><figure><img src=u><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>', [("media", None, "inner outer")]),
        ('<figure><img src=u><figure><img src=v><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>', [("media", None, "out"), ("media", None, "in")]),
        ('<img src=u alt=a><figcaption>one</figcaption><figcaption>two</figcaption>', [("media", None, "one two")]),
        ('<picture><source srcset="x 1x, y 2x"><img srcset="z"></picture><video poster=p src=q></video><object data=o></object>', [("media", None, None)] * 5),
        ('a<figcaption>rest <p>of the page', [("text", "a", None), ("text", "rest of the page", None)]),
    ],
)
def test_captions_without_an_end(html, want):
    assert [(i["kind"], i["text"], i["caption"]) for i in media.sequence(html)] == want


def test_shards_are_even_and_groups_whole(spark):
    out = sharding.op2_label_propagation(spark, SF)
    per = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()
    assert len(per) == 24 and max(r.n for r in per) - min(r.n for r in per) <= 1 and all(r.lo == 0 and r.hi == r.n - 1 and r.d == r.n for r in per)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cut = out.join(docs, "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("s"))
    assert cut.agg(F.max("s")).first()[0] == 1
    big = spark.createDataFrame([(i, "g" if i < 40 else None) for i in range(100)], "node long, link string")
    placed = sharding.shard_by_propagation(big, 5).filter("link = 'g'").agg(F.countDistinct("shard")).first()[0]
    assert placed == 2


def test_mix_meets_targets(spark):
    rows = mixing.op3_entropy_mixing(spark, SF).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.02 * target + 50 and target <= 3 * size + 1e-6
    again = mixing.op3_entropy_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_targets_reshare(spark):
    df = spark.createDataFrame([("a", 100), ("b", 1), (None, 99)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got["b"] == 3.0 and got["a"] == pytest.approx(197 / 4) and got[None] == pytest.approx(197 * 3 / 4)


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("paired", [48, 2])
def test_jaccard_components(spark, monkeypatch, paired):
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    rng = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    for i in range(120):  # a group of near copies whose links are not all direct
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            words[at] = f"x{rng.integers(0, 50)}"
        rows.append((1000 + i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: sets_of(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = toxicity.op5_toxicity(spark, d)
    j = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 for r in j)
    hit = [r.predicted for r in j if r.toxic == 1]
    false = [r.predicted for r in j if r.toxic == 0]
    assert np.mean(hit) > 0.4 and np.mean(false) < 0.05


def test_one_class_scores_zero():
    assert toxicity.Scorer(toxicity.fit(["a b"], [0])).score(["x", ""]).tolist() == [0.0, 0.0]


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 100):
        ids, mask, _ = toxicity.lay_out([np.arange(1, n + 1, dtype=np.int32)])
        assert set(range(1, n + 1)) <= set(ids[mask].tolist())


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = langid.op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97


def test_every_labelled_language_is_known(spark):
    rng = np.random.default_rng(2)
    words = {f"l{i:03}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for i in range(130)}
    rows = [(n, " ".join(rng.choice(w, 40)), lang) for n, (lang, w) in enumerate((x for x in words.items() for _ in range(2)))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.texts) == set(words)
    asked = [" ".join(w[::-1]) for w in words.values()] + ["", "12"]
    tags, scores = langid.predict(model, asked)
    assert tags == [*words, langid.UNKNOWN, langid.UNKNOWN]
    dealt = langid.grouped(model, 2_000)
    tags_, scores_ = langid.predict(model, asked, dealt)
    assert len(dealt) > 5 and tags_ == tags and np.allclose(scores_, scores)


def test_a_languages_text_does_not_shrink_with_their_number(spark):
    rows = [(i * 30 + j, f"{chr(97 + i)}bc " * 500, f"l{i:02}") for i in range(20) for j in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {len(t) for t in model.texts.values()} == {langid.LANG_CHARS}


def test_cross_parsing_equals_brute_force():
    model = langid.Model({"a": "abracadabra abra", "b": "banana bandana"})
    p = langid.parser(model)
    for text in ("abra banana", "zzz", "bandabra", "a", ""):
        total, _, _ = p.phrases([text])
        for j, lang in enumerate(p.langs):
            train, n, i = model.texts[lang], 1, 0
            length = 0
            for c in text:  # a phrase ends where it no longer occurs; the character begins the next
                if text[i : i + length] + c in train:
                    length += 1
                else:
                    n, i, length = n + 1, i + length, 1 if c in train else 0
                    i = i if length else i + 1
            assert total[0, j] == (n if text else 0)


def test_packing(spark):
    rows = packing.op7_best_fit_packing(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 4096) * 1.05 + 2
    enc = tokens.encoder(tokens.default_path("word_bpe_49k.json"), "word")
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect():
        ids = np.array(enc.lib.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.piece)
        assert [(x.start, x.length, x.ids_crc32) for x in own] == [(i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)]


@pytest.mark.parametrize("kind, name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_cached_ids_equal_the_library(kind, name):
    rng = np.random.default_rng(1)
    letters = list("ab cé  \n\t'stréÉ12½²_-.,!  ̈́　 日本<|endoftext|>\x1c​́Ⅷ")
    enc = tokens.encoder(tokens.default_path(name), kind)
    for _ in range(800):
        t = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert enc.encode([t])[0] == np.array(enc.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("lot, known, runs", [(12_000_000, 1_000_000, 300_000), (300, 60, 40)])
@pytest.mark.parametrize("kind, name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_ids_equal_a_fresh_library(kind, name, lot, known, runs):
    """Many texts at once, strings of added tokens among them, with stores that overflow."""
    rng = np.random.default_rng(5)
    parts = [*"ab cé  \n\t'stréÉ12½²_-.,!  ̈́　 日本\x1c​́Ⅷ\r\x0b\x00", "<|endoftext|>", "<|startoftext|>", "'re", " \n ", "\n\n  x"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(2500)] + ["x <|endoftext|> y", "", " ", "word " * 30_000]
    enc, fresh = tokens.ChunkEncoder(tokens.default_path(name), kind, tokens.Room(lot, known, runs)), Tokenizer.from_file(tokens.default_path(name))
    assert enc.encode(texts) == [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_neighbours(spark):
    rows = neighbours.op8_learned_partitions(spark, "/root/testdata/sf0.01").collect()
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], np.float64)
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = (v * v[ids == q]).sum(axis=1)
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits += len(best & {r.vec_id for r in rows if r.query_id == q}) / 20
    assert hits / (ids % 20 == 0).sum() >= 0.9


@pytest.mark.parametrize("seed", [0, 1])
def test_neighbours_where_parts_are_skipped(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.7).astype("f4")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    fitted, fit = [], neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a, **b: fitted.append(fit(*a, **b)) or fitted[-1])
    found = neighbours.search(rows, F.col("vec_id") % 20 == 0, sample=400, part_rows=250).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect()
    s = v[::20].astype(float) @ v.T.astype(float)
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    recall = np.mean([len(set(r.ids) & set(best[r.query_id // 20])) / 20 for r in found])
    assert len(found) == 200 and fitted[0].visits < fitted[0].parts and recall >= neighbours.RECALL


def test_held_out_vectors_teach_nothing():
    x = np.random.default_rng(3).normal(size=(400, 8))
    other = x.copy()
    other[neighbours.HELD - 1 :: neighbours.HELD] *= -1
    a, b = neighbours.fit(x, 4, epochs=2), neighbours.fit(other, 4, epochs=2)
    assert all((p == q).all() for p, q in ((a.w1, b.w1), (a.b1, b.b1), (a.w2, b.w2), (a.b2, b.b2)))


def test_neighbours_of_a_small_part(spark, monkeypatch):
    router = neighbours.Router(np.array([[1.0], [0.0]]), np.zeros(1), np.array([[1.0, -1.0]]), np.zeros(2), 1)
    monkeypatch.setattr(neighbours, "fit", lambda *a, **b: router)
    rows = spark.createDataFrame([(i, [1.0 if i < 3 else -1.0, float(i)]) for i in range(40)] + [(0, [2.0, 0.5])], "vec_id long, embedding array<float>")
    got = neighbours.search(rows, F.col("vec_id").isin(1, 10)).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 20, 10: 20}


def test_bisection_is_balanced():
    rng = np.random.default_rng(0)
    near = rng.integers(0, 333, (333, 5))
    assert np.ptp(np.bincount(neighbours.bisect(near, 8))) <= 2


def test_license_templates(spark, awkward):
    a = licenses.Automaton([("t", "a <<beginOptional>>b <<var;match=\"[0-9]+\";max=2>><<endOptional>> c")])
    assert [a.matches(w.split()) for w in ("x a c", "a b 1 2 c", "a b 1 2 3 c", "a b c", "a d c")] == [[(1, 2, "t")], [(0, 5, "t")], [], [], []]
    got = {r.doc_id: r for r in licenses.scan_licenses(awkward.select("doc_id", "text")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels) == (1, 3, "mit", "mit,mit-notice")
    assert got[3].n_words == 0 and got[3].first_word is None


@pytest.mark.parametrize("n", [0, 1, 15, 16384, 16385, 100000])
def test_coder_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint32)
    frame = rans.encode(ids)
    assert np.array_equal(rans.decode(frame), ids)
    if n > 20000:
        assert np.array_equal(rans.decode(frame, [2]), ids[32768:49152])
        frame.words = frame.words[:8] + bytes([frame.words[8] ^ 1]) + frame.words[9:]
        with pytest.raises(ValueError):
            rans.decode(frame)


def test_token_files(spark):
    got = {r.doc_id: r for r in token_files.op10_token_files(spark, SF).collect()}
    enc, at = tokens.encoder(tokens.default_path("byte_bpe_50k.json"), "byte"), 0
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array(enc.lib.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pipeline_stages_take_effect(spark, awkward):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, awkward, SF)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 5, 6, 8, 9]
    one = stages["near duplicates"](spark, awkward, SF)
    assert sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 3, 4, 5, 7, 8, 9]


def test_stages_keep_columns_of_any_name(spark, awkward):
    """Columns with the names that stages, or the operators under them, might use stay as they are."""
    names = ["__h", "__copies", "__copy", "__lang", "__score", "__toxicity", "__kd", "__kh", "__d", "__k", "__n", "__size", "__source", "__rank", "__local", "__kb", "__k0", "__s", "__z", "__c", "H", "group_key", "copies", "target"]
    wide = awkward.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        for r in out.collect():
            own = "-" if r.doc_id is None else r.doc_id
            assert [r[n] for n in names] == [f"{n} {own}" for n in names], name
    assert stage is not None and corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() >= awkward.count()


def test_mixing_stage_deals_copies(spark, awkward):
    """Documents of a source come as often as op 3 says of the same table, equal rows together."""
    out = dict(corpus_pipeline.STAGES)["mixing"](spark, awkward, SF)
    small = awkward.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64(*awkward.columns).alias("h"))
    want = {}
    for r in mixing.mix(small, "size", "source", ["doc_id", "h"]).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_toxicity_and_packing_stages(spark):
    """The toxicity stage drops what the operator scores 0.7 or more, and nothing else; packing keeps every token once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scored = {r.doc_id: r.score for r in toxicity.op5_toxicity(spark, SF).collect()}
    assert {r.doc_id for r in stages["toxicity"](spark, docs, SF).select("doc_id").collect()} == {d for d, s in scored.items() if s < toxicity.THRESHOLD}
    packed = stages["packing"](spark, docs, SF)
    want = packing.pieces(docs).agg(F.sum("length"), F.count("*")).first()
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert (sum(r.n for r in sums), packed.count()) == tuple(want) and all(r.n == r.end <= 4096 for r in sums)
