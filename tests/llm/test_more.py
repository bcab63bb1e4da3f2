"""Further cases of the corpus operators: sites made up for their templates, all code points, stored tensors, targets, odd tables."""

import hashlib
import io
import random
import sys
import time
import unicodedata
import wave
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from specto.llm import audio, bloom, bpe, dedup, edits, html, jaccard, langid, license, mixing, substring
from specto.llm.common import LOWER, UPPER

LONG = "A long sentence of the article that has quite a few words in it."
SF = "/root/testdata/sf0.01"


def words_like(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body class="home no-sidebar"><article><p>{LONG}</p></article></body>', LONG),
        (f'<div class="post has-comments">{LONG}</div>', LONG),
        (f'<main class="search-results">{LONG}</main>', LONG),
        (f'<article><section class="share-price">{LONG}</section></article>', LONG),
        ("<p>a</p><button>b<p>c</p>", "a\n\nc"),
        ("<div><form><p>q</p><div>rest of page</div></body>", "q\n\nrest of page"),
        (f"<form><div>{LONG}</div></form>", LONG),
        ('<p>text <span class="advert">BUY <b>NOW</b></span> more</p>', "text more"),
        ('<p>text <span class="x">is</span> more</p>', "text is more"),
        (f'<article>{LONG}</article><article class="card">teaser</article>', LONG),
        (f"<nav><ul><li>x</li></ul><article>{LONG}</article>", LONG),
        (f'<div class="cookie-banner">ok?</div><p>{LONG}</p><div class="reader comments"><p>{LONG} Me too.</p></div>', LONG),
        (f"<p>{LONG}</p><aside>{LONG}</aside><!-- {LONG} --><style>{LONG}</style>", LONG),
        ("<div>" * 5000 + LONG, LONG),
        (f"<p>{LONG}" * 3000, "\n\n".join([LONG] * 3000)),
        ("<p>caf&eacute; &#x41;&#66; &amp;lt; a b\n\tc", "café AB &lt; a b c"),
    ],
)
def test_page(page, text):
    assert html.main_text(html.parse(page)) == text


def site(rng, host, n):
    """Pages without one class word that tells: only what recurs on the host marks its menu, its notice and its box of links."""
    rows = []
    for i in range(n):
        links = "".join(f"<div><a href=/{w}>{w}</a></div>" for w in words_like(rng, 6).split())
        box = "".join(f"<p><a href=/{w}>{w}</a></p>" for w in words_like(rng, 8).split())
        body = [words_like(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        shared = ["The same words on all pages of the site, but within the text."] if i % 2 else []
        inner = "".join(f"<p>{b}</p>" for b in body + shared)
        rows.append((f"http://{host}/{i}", f"<body><div class=k1>{links}</div><div class=k2>Terms of {host} apply to all.</div><div class=k3>{inner}</div><section class=k4>{box}</section></body>", "\n\n".join(body)))
    return rows


def test_only_recurrence_tells(spark):
    """What is alone on its host stays, what recurs goes; the same pages under hosts of their own keep all."""
    rng = random.Random(5)
    rows = [r for h in range(4) for r in site(rng, f"h{h}.org", 12)]
    pages = spark.createDataFrame([(i, u, h, "clash") for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.op9_html_text(pages).collect()}
    for i, (_, _, want) in enumerate(rows):
        assert got[i].text == want and got[i].n_chars == len(want)
    apart = pages.withColumn("url", F.concat(F.lit("http://own"), "page_id", F.lit(".org/")))
    alone = {r.page_id: r.text for r in html.op9_html_text(apart).collect()}
    assert all("Terms of" in alone[i] and len(alone[i]) > len(got[i].text) for i in alone)


def test_page_of_articles_whatever_its_noise(spark):
    """Random pages, each article known: the text is the article's, with any mix of noise around and in it."""
    rng = random.Random(9)
    noise = [lambda: f"<nav><ul><li>{words_like(rng, 3)}</ul></nav>", lambda: f"<div class='ad'>{words_like(rng, 9)}</div>", lambda: f"<header><h2>{words_like(rng, 4)}</h2></header>", lambda: f"<footer>{words_like(rng, 5)}</footer>", lambda: f"<script>if(a<b)c('</p>')</script>", lambda: f"<form><label>{words_like(rng, 2)}</label><button>go</button></form>", lambda: f"<!-- {words_like(rng, 3)} -->", lambda: f"<div id=comments>{words_like(rng, 30)}</div>", lambda: f"<aside>{words_like(rng, 6)}</aside>"]
    rows, want = [], []
    for i in range(120):
        blocks = [words_like(rng, rng.randint(8, 40)) for _ in range(rng.randint(1, 5))]
        inside = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<div><p>{}</p></div>", "<blockquote>{}</blockquote>"]).format(b) + (rng.choice(noise[1:2] + noise[4:]) () if rng.random() < 0.3 else "") for b in blocks)
        around = [rng.choice(noise)() for _ in range(4)]
        rows.append((i, f"http://x{i % 7}.net/{i}", f"<html><body>{around[0]}{around[1]}<article>{inside}</article>{around[2]}{around[3]}</body></html>"))
        want.append("\n\n".join(blocks))
    got = {r.page_id: r.text for r in html.op9_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_odd_page_tables(spark):
    rows = [(None, None, f"<p>{LONG}</p>"), (1, "http://a.b/", None), (1, "http://a.b/", None), (2, "no url", "")]
    got = html.op9_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, LONG, len(LONG)), (1, "", 0), (1, "", 0), (2, "", 0)]


def test_every_code_point_as_the_library_has_it():
    from tokenizers import Tokenizer

    ref, own = Tokenizer.from_file(bpe.default_path()), bpe.WordBpe(bpe.default_path())
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a1{c} b{c}!" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    rng = random.Random(1)
    marks = [c for c in points if unicodedata.combining(c)]
    texts += ["".join(rng.choice([rng.choice(points), rng.choice(marks), rng.choice("ab1' !.\n")]) for _ in range(30)) for _ in range(3000)]
    for text, want in zip(texts, ref.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want.ids


def test_bpe_ids_decode(spark):
    rows = [(1, "Some words, again and again"), (1, "Some words, again and again"), (None, None), (2, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    own = bpe.WordBpe(bpe.default_path())
    for r in bpe.bpe_roundtrip(df, keep_ids=True).collect():
        raw = np.array(r.ids, "<u4").tobytes()
        assert len(r.ids) == r.n_tokens and hashlib.sha256(raw).hexdigest() == r.ids_sha256 and hashlib.sha256(own.decode(raw).encode()).hexdigest() == r.decoded_sha256


def test_only_surviving_groups_are_hashed(spark):
    """With room for all keys only rows whose length and prefix occur twice pass; with almost none more do, and the rows stay the same."""
    rng = random.Random(2)
    texts = [words_like(rng, 40) for _ in range(300)] + ["same text"] * 5 + ["a" * 200 + "b", "a" * 200 + "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select(F.octet_length("text").alias("len"), F.xxhash64(F.substring("text", 1, 128)).alias("prefix"))
    keys = rows.groupBy("len", "prefix").count().where("count > 1").select("len", "prefix")
    key = F.xxhash64("len", "prefix")
    told = lambda bits: bloom.passes(rows, key, *bloom.key_filter(keys, key, bits)).where("__pass").count()
    assert told(1 << 28) == 7 and bloom.rows_of(rows, keys, ["len", "prefix"], "left_semi").count() == 7
    whole = {tuple(r) for r in dedup.exact_dedup(df, digest=True).collect()}
    assert whole == {tuple(r) for r in dedup.exact_dedup(df, digest=True, max_bits=1).collect()} and sum(r[3] for r in whole) == 303


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "A b", "en", "s", "mine"), (2, "a B", "en", "s", "mine"), (2, "other", "en", "s", "mine")], "doc_id long, text string, lang string, source string, row string")
    names = ("__id", "__mark", "__part", "__bits", "__pass", "mark", "id", "hash", "len", "prefix", "carried", "weight", "probability")
    own = df.select("*", *[F.lit("mine").alias(n) for n in names])
    for kept in (dedup.drop_copies(own), mixing.sample_mixture(own, 1.0), langid.keep_identified(own, None)):
        assert kept.columns == own.columns
    kept = dedup.drop_copies(own).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(2, "a B"), (2, "other")] and all(r[n] == "mine" for r in kept for n in names)


def features_by_hand(samples):
    """The same features in plain steps: an output sample is a dot product with the filter's phase, a frame a windowed transform."""
    s = audio.Settings()
    own = audio.Extractor(s)
    n = len(samples) * s.up // s.down
    n_frames = max(1, 1 + -(-(n - s.frame) // s.hop))
    need = (n_frames - 1) * s.hop + s.frame
    x = (samples.astype(np.float64) - 128) / 128
    y = np.zeros(need)
    for i in range(need):
        at, phase = divmod(i * s.down, s.up)
        for j in range(s.taps):
            k = at - s.taps + 1 + j
            if 0 <= k < len(x):
                y[i] += own.phases[phase][j] * x[k]
    mel, level = [], []
    for f in range(n_frames):
        cut = y[f * s.hop : f * s.hop + s.frame]
        power = np.abs(np.fft.fft(cut * np.hanning(s.frame), s.fft)[: s.fft // 2 + 1]) ** 2
        mel.append(10 * np.log10(power @ own.filters + 1e-6))
        level.append(10 * np.log10((cut**2).mean() + 1e-6))
    return np.array(mel), np.array(level)


def test_audio_features_by_hand(spark, monkeypatch):
    rng = random.Random(4)
    for size in (64, 640, 4096):
        samples = np.array([rng.randrange(256) for _ in range(size)], np.uint8)
        mel, level = features_by_hand(samples)
        for block in (4096, 5):  # also over the seam between blocks of frames
            tensors, got, spans = audio.Extractor(audio.Settings(block=block)).features(samples)
            flat = tensors.reshape(-1, 24)
            assert np.allclose(flat[: len(mel)], mel, atol=1e-2) and np.allclose(got, level, atol=1e-3) and (flat[len(mel) :] == flat[: len(mel)].min()).all()
            on, marks = False, []
            for v in got.astype(np.float64):
                on = True if v > got.mean(dtype=np.float64) + got.std(dtype=np.float64) / 2 else False if v < got.mean(dtype=np.float64) else on
                marks.append(on)
            assert {i for a, b in spans for i in range(a, b)} == {i for i, m in enumerate(marks) if m}


def test_audio_rows(spark):
    texts = [None, "", "a" * 64, "é" * 40, "long " * 9000, "long " * 9000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r.doc_id: r for r in audio.op3_audio_features(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        with io.BytesIO() as out:
            with wave.open(out, "wb") as w:
                w.setparams((1, 1, 8000, 0, "NONE", ""))
                w.writeframes(padded)
            media = out.getvalue()
        assert (rows[i].tail_crc32, rows[i].media_bytes, rows[i].media_sha256) == (zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())
    assert rows[0].feature == rows[1].feature and rows[4].feature == rows[5].feature and len({r.feature for r in rows.values()}) == 4
    stored = audio.stored(np.arange(2 * 32 * 24, dtype=np.float32).reshape(2, 32, 24), audio.Settings())
    assert audio.described(stored, 40, [(1, 3)]) != audio.described(stored, 40, [(1, 4)])


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(rows) > 200 and (rows.lang == rows.lang_pred).mean() > 0.99


def test_license_labels_by_hand(spark):
    """Each template, whole and with words put in, gets its label; its words in another order don't."""
    rng = random.Random(8)
    rows, want = [], []
    for label, template in license.TEMPLATES.items():
        words = template.split()
        rows.append(" ".join([words_like(rng, 9), template, words_like(rng, 9)]))
        want.append((label, True))
        if len(words) > 15:
            at = rng.randrange(4, len(words) - 4)
            rows.append(" ".join(words[:at] + ["inserted"] + words[at:]))
            want.append((label, True))
            mixed = words[:]
            rng.shuffle(mixed)
            rows.append(" ".join(mixed))
            want.append((label, False))
    got = {r.doc_id: r for r in license.op6_license_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, (label, found) in enumerate(want):
        assert (label in got[i].labels.split(",")) == found, (label, rows[i], got[i].labels)


def test_mixing_targets(spark):
    rng = random.Random(6)
    rows = [(i, words_like(rng, rng.randint(5, 20)), rng.choice(["en", "en", "fr", None]), rng.choice(["web", "web", "web", "book", "code"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"web": 1, "book": 2}, "lang": {"en": 1, None: 1, "fr": 2}}
    topic = F.when(F.col("doc_id") % 3 == 0, "third").otherwise("rest")
    mixed = mixing.mix(df, targets=targets, topic=topic).toPandas().fillna("null")
    assert mixed.probability[mixed.source == "code"].max() == 0 and set(mixed.topic) == {"third", "rest"}
    drawn = mixed.assign(x=mixed.tokens * mixed.probability)
    shares = lambda c: (drawn.groupby(c).x.sum() / drawn.x.sum()).to_dict()
    assert np.isclose(shares("source")["book"], 2 / 3, atol=1e-5) and np.isclose(shares("lang")["fr"], 0.5, atol=1e-5) and np.isclose(shares("lang")["null"], 0.25, atol=1e-5)
    cells = df.select(*map(mixing.cell, ("source", "lang")), mixing.topic_of(F.col("text")).alias("__topic"), mixing.tokens_of(F.col("text")).alias("tokens")).groupBy("__source", "__lang", "__topic").agg(F.sum("tokens").alias("tokens"))
    off = [mixing.deviation(mixing.rake(cells, n, targets)) for n in (1, 12)]
    assert off[0] > off[1] and off[1] < 1e-9
    part = mixing.sample_mixture(df, 0.3, targets)
    assert part.where("source = 'code'").count() == 0 and part.columns == df.columns


def test_level(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random() * 3) for _ in range(50)] + [(0.0, 2.0)]
    df = spark.createDataFrame(rows, "x double, cap double")
    for total in (0.5, 40.0, 1e9):
        f = mixing.level(df, "x", "cap", total)
        assert np.isclose(sum(min(c, x * f) for x, c in rows if x), min(total, sum(c for x, c in rows if x)))


def test_long_texts(spark):
    """Texts beyond any block, frame or leaf: each operator gives what it gives for short ones."""
    rng = random.Random(7)
    base = words_like(rng, 6_000)
    near = base.replace(base.split()[77], "changed", 1)
    df = spark.createDataFrame([(1, base), (2, base.upper()), (3, near), (4, "x" * 20_000)], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in dedup.op2_exact_dedup(df).collect()} == {1: 2, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard.op4_ngram_jaccard(df).collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring.op7_substring_dedup(df).collect()}
    assert removed[1] == (6_000, 0) and removed[3][1] >= 5_900 and removed[4] == (1, 0)
    assert {r.doc_id: r.n_edits for r in edits.edited_counts(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_operators_repeat_rows(spark):
    df = spark.createDataFrame([(1, "some words of a text"), (2, None)], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    twice = df.unionByName(df)
    for one in (lambda d: langid.identify(d, langid.train(d)), audio.op3_audio_features, edits.edited_counts, bpe.bpe_roundtrip, mixing.op10_source_mixing, license.op6_license_scan):
        rows = [tuple(r) for r in one(twice).collect()]
        assert len(rows) == 4 and len(set(rows)) == 2


def test_each_stage_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    made = {"en": "the and of that with his they".split(), "de": "der und nicht sich über ein mit".split()}
    rows = []
    for i in range(160):
        lang = ["en", "de"][i % 2]
        rows.append((i, " ".join(rng.choices(made[lang] * 12 + [f"{lang}{j}" for j in range(60)], k=rng.randint(12, 60))), lang if i % 5 else None, f"s{i % 3}", i))
    rows += [(200 + i, rows[i][1].upper(), ["en", "de"][i % 2], "s0", i) for i in range(10)]
    rows += [(300 + i, rows[20 + i][1] + " more", ["en", "de"][i % 2], "s1", i) for i in range(10)] + [(400, "12 !", None, "s2", 0), (401, None, None, "s2", 0), (402, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__mark", F.lit("odd"))
    stages = dict(corpus_pipeline.STAGES)
    left = {r.doc_id: r for r in stages["language"](spark, docs, "").collect()}
    assert set(left) == {r[0] for r in rows} - {400, 401, 402} and all(left[i].lang == ["en", "de"][i % 2] for i in range(160))
    d = docs.where(F.col("doc_id").isin(list(left)))
    kept = {r.doc_id for r in stages["exact"](spark, d, "").collect()}
    low = lambda t: t.translate(str.maketrans(UPPER, LOWER))
    last: dict[str, int] = {}
    for i in sorted(left):
        last[low(left[i].text)] = i
    assert kept == set(last.values())
    d = d.where(F.col("doc_id").isin(list(kept)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i in kept if (w := low(left[i].text).split())}
    own = {i: i for i in kept}
    for _ in range(5):
        for i in sets:
            for j in sets:
                if own[i] != own[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    own[i] = own[j] = min(own[i], own[j])
    near = {r.doc_id for r in stages["near"](spark, d, "").collect()}
    assert near == {i for i in kept if own[i] == i} and len(near) < len(kept)
    mixed = mixing.mix(d, share=corpus_pipeline.TOKEN_SHARE, targets=corpus_pipeline.TARGETS).toPandas()
    hashed = {i: int(hashlib.sha256(f"mix{i}".encode()).hexdigest()[:12], 16) / 2**48 for i in kept}
    sampled = stages["mixture"](spark, d, "")
    assert sampled.columns == docs.columns and {r.doc_id for r in sampled.collect()} == {r.doc_id for r in mixed.itertuples() if hashed[r.doc_id] < r.probability}
    ids = {r.doc_id: r.ids for r in stages["tokens"](spark, d, "").collect()}
    encoder = bpe.WordBpe(bpe.default_path())
    assert ids == {i: np.frombuffer(encoder.encode(left[i].text), "<u4").tolist() for i in kept}
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sql_of_mixing(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(mixing.op10_sql()).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.op10_source_mixing(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got.sampled == want.sampled).all() and np.allclose(got.weight, want.weight) and np.allclose(got.probability, want.probability)


def test_html_keeps_main_texts(spark):
    """Marks, links and recurrence never take what holds most of a page, nor an article."""
    rng = random.Random(8)

    def text(words=60):
        return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(words))

    same = text()
    sites = [
        lambda i, t: f'<div class="card"><p>{t}</p></div>',
        lambda i, t: f'<div class="widget"><article>{t}</article></div>',
        lambda i, t: f'<main><section class="social">{t}</section></main>',
        lambda i, t: f'<article><h1>Head</h1><div class="card">{t}</div></article>',
        lambda i, t: f'<div class="content sidebar"><article>{t}</article></div>',
        lambda i, t: f"<nav>menu {i} {i}</nav><article><div><p>{same}</p></div></article>",
        lambda i, t: f"<nav>menu {i} {i}</nav><div><p>{same}</p><p>{same[::-1]}</p></div>",
        lambda i, t: f'<div class="content"><p><a href="/">{t[:240]}</a>{t[240:]}</p></div>',
    ]
    want = [lambda i, t: t] * 3 + [lambda i, t: f"Head\n\n{t}", lambda i, t: t, lambda i, t: same, lambda i, t: f"{same}\n\n{same[::-1]}", lambda i, t: t]
    rows, texts = [], {}
    for s, site in enumerate(sites):
        for i in range(3 if s == 4 else 10):
            t = text()
            texts[100 * s + i] = want[s](i, t)
            rows.append((100 * s + i, f"http://s{s}.org/{i}", f"<html><body>{site(i, t)}</body></html>"))
    got = html.op9_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == texts


def test_no_shuffle_files_stay(spark):
    import glob

    from specto.llm.common import cut, tidy

    def files():
        return set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*", recursive=True))

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), files()
    kept = cut(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    left = files() - before
    assert not left, sorted(left)
    assert spark.conf.get(key) == setting
    assert sorted(r["count"] for r in kept.collect()) == [142, 143, 143, 143, 143, 143, 143]
    plan = spark.range(1000).selectExpr("id % 7 AS k")
    with tidy(spark):
        again = plan.distinct()
        assert len(again.collect()) == len(again.collect()) == 7  # a plan that runs again makes its shuffles anew
