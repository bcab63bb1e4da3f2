"""The corpus operators against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from specto.llm import audio, bpe, components, dedup, edits, fmindex, html, jaccard, langid, license, mixing, substring
from specto.llm import queries as registered

random.seed(11)
VOCAB = [f"w{i}é" if i % 5 == 0 else f"W{i}" for i in range(40)]


def phrase(n):
    return " ".join(random.choices(VOCAB, k=n))


BASE, PASSAGE = phrase(90), phrase(70)
TEXTS = [None, "", "   ", "one two", "ONE two", "ſ Kelvin K", BASE, BASE.upper(), BASE + " tail", "x " + BASE, BASE.replace(" ", "\n", 3), phrase(10) + " " + PASSAGE + " " + phrase(8), phrase(20) + " " + PASSAGE, PASSAGE + " " + PASSAGE, "a\x0bb\x1cc\xa0d", " ".join(["go"] * 160), " ".join(["go"] * 170)]
TEXTS += [phrase(random.choice([3, 30, 60])) for _ in range(25)] + [" ".join((BASE.split() + ["z"])[i:]) for i in range(6)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, n_words string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text, lower=False):
    raw = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.lower() if lower else raw)


def shingles(text):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_dedup(docs, empty):
    got = {r.doc_id: r for r in dedup.op2_exact_dedup(docs).collect()}
    norm = [re.sub("[A-Z]+", lambda m: m[0].lower(), t or "") for t in TEXTS]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert dedup.op2_exact_dedup(empty).count() == 0
    assert {r.doc_id for r in dedup.drop_copies(docs).collect()} == {i for i in got if got[i].kept}


def test_repeated_rows(docs):
    twice = docs.unionByName(docs)
    assert dedup.op2_exact_dedup(twice).count() == 2 * len(TEXTS)
    one = {tuple(r) for r in jaccard.op4_ngram_jaccard(docs).collect()}
    two = jaccard.op4_ngram_jaccard(twice).collect()
    assert len(two) == 2 * len(TEXTS) and {tuple(r) for r in two} == one
    # ids that stand at several texts: each of them is a document of its own
    more = docs.unionByName(docs.withColumn("doc_id", F.lit(30) - F.col("doc_id") % 4)).unionByName(docs)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(30 - i % 4, t) for i, t in enumerate(TEXTS)]
    known = {(i, frozenset(s)) for i, t in rows if (s := shingles(t))}
    links = {(i, s): sum((j, r) != (i, s) and 100 * len(r & s) >= 80 * len(r | s) for j, r in known) for i, s in known}
    got = {(r.doc_id, r.n_shingles, r.n_links) for r in jaccard.op4_ngram_jaccard(more).collect()}
    assert got == {(i, len(s), n) for (i, s), n in links.items()} | {(i, 0, 0) for i, t in rows if not shingles(t)}
    assert substring.op7_substring_dedup(twice).distinct().count() == len(TEXTS)
    assert license.op6_license_scan(twice).count() == 2 * len(TEXTS)


def test_jaccard(docs, empty):
    sets = []
    for t in TEXTS:
        w = words(t, True)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    own = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    own[i] = own[j] = min(own[i], own[j])
    links = [sum(i != j and bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.op4_ngram_jaccard(docs).collect()}
    assert got == {i: (len(s), own[i], links[i]) for i, s in enumerate(sets)}
    assert len(set(own)) < len(own) - 5
    assert jaccard.op4_ngram_jaccard(empty).count() == 0


def test_trie():
    for _ in range(200):
        sets = [np.unique(np.random.randint(0, 30, random.randint(1, 25))).astype(np.uint64) for _ in range(8)]
        one = np.unique(np.random.randint(0, 30, 20)).astype(np.uint64)
        want = [i for i, s in enumerate(sets) if 100 * len({*s} & {*one}) >= 80 * len({*s} | {*one})]
        assert sorted(jaccard.Trie(sets).similar(one, 80, step=3)) == want


def test_trie_skips_subtrees():
    """Of a thousand sets that share a start which the one lacks, only the first is read."""
    start = np.arange(1000, 1060, dtype=np.uint64)
    trie = jaccard.Trie([np.concatenate((start, np.sort(np.random.choice(np.arange(2000, 9000, dtype=np.uint64), 40, replace=False)))) for _ in range(1000)])

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return list.__getitem__(self, i)

    trie.sets = Counted(trie.sets)
    assert trie.similar(np.arange(1, 101, dtype=np.uint64), 80, step=16) == [] and Counted.reads == 1


@pytest.mark.parametrize("block", [3, 256])
def test_pairs_between_parts(spark, block):
    """Blocks of any size propose each pair of different components that share enough n-grams, and no other."""
    rows = [(k, i) for k in range(6) for i in range(40) if (i * 7 + k * 3) % 5 < 3]
    lists = spark.createDataFrame([(k, i, 6, 5, 0) for k, i in rows], "key long, id long, n long, last long, size long")
    joined = spark.createDataFrame([(i, 0) for i in range(0, 30, 2)] + [(31, 31), (33, 31)], "node long, component long")
    part = {i: i for i in range(40)} | {i: 0 for i in range(0, 30, 2)} | {33: 31}
    rule = jaccard.Jaccard()
    need = lambda shared: shared + -(-6 * 80 // 100) - 1 >= -(-12 * 80 // 180)
    shared = {(a, b): len({k for k, i in rows if i == a} & {k for k, i in rows if i == b}) for a in range(40) for b in range(a + 1, 40)}
    want = {p for p, n in shared.items() if n and part[p[0]] != part[p[1]] and need(n)}
    got = jaccard.across_parts(lists, joined, rule, block).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_fm_index():
    for _ in range(60):
        width = random.choice([3, 5])
        segments = [np.random.randint(1, 4, random.randint(width, width + 10)) for _ in range(random.randint(1, 8))]
        owners = np.array([random.randint(0, 4) for _ in segments])
        got = fmindex.matched_windows(fmindex.FmIndex(segments, owners), segments, owners, width)
        held = [{tuple(s[i : i + width]) for i in range(len(s) - width + 1)} for s in segments]
        for i, s in enumerate(segments):
            assert sorted(got[i]) == [x for x in range(len(s) - width + 1) if any(owners[j] < owners[i] and tuple(s[x : x + width]) in held[j] for j in range(len(segments)))]


def test_lowest_owner():
    for n in (1, 15, 16, 17, 64, 301):
        owner = np.random.randint(0, 50, n).astype(np.int32)
        lo = np.random.randint(0, n, 400)
        hi = np.array([random.randint(a + 1, n) for a in lo])
        assert fmindex.LowestOwner(owner).query(lo, hi).tolist() == [owner[a:b].min() for a, b in zip(lo, hi)]


@pytest.mark.parametrize(("width", "k", "block"), [(50, 25, 2048), (12, 6, 2)])
def test_substring(spark, docs, empty, width, k, block, monkeypatch):
    whole = substring.repeated_spans
    monkeypatch.setattr(substring, "repeated_spans", lambda d, w: whole(d, w, k, block))
    first, all_words = {}, [words(t) for t in TEXTS]
    for d, w in enumerate(all_words):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    got = {r.doc_id: r for r in substring.drop_repeated_passages(docs, width).collect()}
    for d, w in enumerate(all_words):
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed for r in got.values()) > 200
    assert substring.drop_repeated_passages(empty, width).count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.default_path())
    extra = ["<|endoftext|> a", "Σας ΣΑΣ İ", "é" * 5, "x" * 300, "日本 ½ 👍'S"]
    own = bpe.WordBpe(bpe.default_path())
    for t in [t or "" for t in TEXTS] + extra:
        want = ref.encode(t, add_special_tokens=False).ids
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == ref.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r.n_tokens for r in bpe.bpe_roundtrip(docs).collect()}
    assert got == {i: len(ref.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert bpe.bpe_roundtrip(empty).count() == 0


def test_edits(docs, empty):
    encode = edits.byte_bpe()
    for _ in range(150):
        text = "".join(random.choices(["a", "b", " ", " ", "\n", "1234", "'s", "é", "  ", "x y z "], k=random.randint(0, 60)))
        own = edits.CountedText(text, encode, leaf=4)
        spans = [(m.start(), m.end(), random.choice(["", " ", "q "])) for m in re.finditer("1234|y", text)]
        new = text
        for a, b, x in reversed(spans):
            new = new[:a] + x + new[b:]
        own.edit(spans)
        assert own.text() == new and own.total == len(encode(new))
    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited) for r in edits.edited_counts(docs).collect()}
    assert got == {i: (len(encode(t or "")), len(encode(re.sub(r"[0-9]{4,}", "[removed]", t or "")))) for i, t in enumerate(TEXTS)}
    assert edits.edited_counts(empty).count() == 0


def test_audio(docs, empty):
    rows = {r.doc_id: r for r in audio.op3_audio_features(docs).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
    assert rows[0].feature == rows[1].feature
    tensors = audio.audio_tensors(docs).toArrow()
    shaped = audio.as_tensors(tensors["logmel"].combine_chunks())
    assert shaped.to_numpy_ndarray().shape[1:] == (32, 24) and audio.op3_audio_features(empty).count() == 0
    own = audio.Extractor(audio.Settings())
    tone = np.round(127 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000) + 128).astype(np.uint8)
    assert np.abs(np.fft.rfft(own.resampled(tone, 0, 6000))).argmax() == 440
    assert own.segments(np.array([0, 0, 9, 9, 5, 9, 0, 0, 0.0])) == [(2, 6)]


def test_license(spark, docs, empty):
    texts = ["Released under the MIT License. mit\nlicense", "GNU General Public License general public", "x" * 5, "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", None, "mit-license é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in license.op6_license_scan(df).collect()}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        at = [(j, label) for p, label in license.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.encode().split()]
        starts = [j for j, _ in at]
        assert (rows[i].n_words, rows[i].n_base, rows[i].first_word, rows[i].last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert rows[i].base_labels == ",".join(sorted({x for _, x in at}))
    assert rows[3].labels == "mit-permission" and 0.6 <= rows[3].score <= 1 and rows[0].labels == "mit,mit-line"
    assert license.op6_license_scan(docs).count() == len(TEXTS) and license.op6_license_scan(empty).count() == 0


def test_langid(spark, empty):
    made = {"aa": "the and of that with", "bb": "der und nicht sich über"}
    rows = [(i, None if i == 5 else "123 --" if i == 6 else " ".join(random.choices(made[lang].split(), k=20)), lang) for i in range(200) for lang in [["aa", "bb"][i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, langid.train(df)).collect()}
    assert got[5].lang_pred == got[6].lang_pred == "und" and got[5].score == 0
    assert all(got[i].lang_pred == lang for i, t, lang in rows if i not in (5, 6)) and any(r.held_out for r in got.values())
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.keep_identified(df, langid.train(df)).count() == 198
    few = langid.sample(df.unionByName(df), "doc_id", "text", "lang", 16)  # repeated rows are drawn once
    ranked = sorted((r.h, r.lang, r.text) for r in df.selectExpr("lang", "text", "xxhash64(text) AS h", "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 AS fold").where("text IS NOT NULL AND fold <> 2").collect())
    grams, want = langid.Grams(), []
    for lang in ("aa", "bb"):
        lowest = [text for _, own, text in ranked if own == lang][:8]
        want += [(lang, np.flatnonzero(seen).tolist()) for text in lowest if (seen := grams.presence(text)) is not None]
    assert [(lang, codes.tolist()) for lang, codes in few] == want


def test_letters_beyond_the_first_plane(spark):
    made = ["the and of that with", "\U0001e900\U0001e901 \U0001e902\U0001e903", "\U00010330\U00010331 \U00010332", "\U00020000\U00020001", "\U0001d400"]
    rows = [(i, made[i % 2], ["en", "ff"][i % 2]) for i in range(60)] + [(100 + i, t, None) for i, t in enumerate([*made, "123 \U0001f600", None])]
    df = spark.createDataFrame(rows + [(200 + i, "the", "und") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert model.langs == ["en", "ff"] and got[1] == got[101] == "ff" and {d for d in got if got[d] == "und"} == {105, 106}
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    for own in (model, langid.train(unlabelled)):
        assert {r.doc_id for r in langid.keep_identified(df, own).collect()} == {*got} - {105, 106}


def test_string_kernel():
    grams = langid.Grams()
    for a, b in (("The cat", "a cat sat"), ("été", "ete")):
        parts = [{x for n in (1, 2, 3) for i in range(len(t) + 3 - n) for x in [f" {t.lower()} "[i : i + n]] if len(x) == n} for t in (a, b)]
        marks = [set(np.flatnonzero(grams.presence(t))) for t in (a, b)]
        assert [len(m) for m in marks] == [len(p) for p in parts] and len(marks[0] & marks[1]) == len(parts[0] & parts[1])


def test_html(spark):
    menu = "<nav><a>Home</a></nav><div>Join <b>now</b></div>"
    rows = [(i, f"http://h.org/{i}", f"<html><head><title>t</title></head><body>{menu}<p>Text &amp; {i}&nbsp; x<p>same<div class='ad'>buy</div><script>p</script></body>") for i in range(8)]
    rows += [(8, None, None), (9, "http://k.org/", "<article><h1>A<br>b</h1><p>same</p><form>f</form><aside>s</aside></article><footer>f</footer>")]
    got = {r.page_id: r for r in html.op9_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Text & 3 x" and got[8].text == "" and got[9].text == "A b\n\nsame" and got[9].n_chars == 9
    assert html.op9_html_text(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_html_open_elements():
    cases = {
        "<body><script>for(i=0;i<n;i++)f(i)</script><p>kept</p></body>": "kept",
        "<title>a <b</title><textarea><p></textarea><p>kept": "kept",
        "<head><title>t</title><p>one<p>two": "one\n\ntwo",
        "<head><noscript><link></head>text": "text",
        "<div>a<button>b</div><p>c</p>": "a\n\nc",
        "<button>b<p>c</p>d": "c\n\nd",
        "<ul><li>a<svg><path><li>b</ul>": "a\n\nb",
        "<p>x <select><option>1</select> y<object><p>z</p></object></p>": "x y",
        "<div><noscript><div><button>x</div></noscript>z</div>": "z",
    }
    for page, text in cases.items():
        assert html.main_text(html.parse(page), ()) == text, page


def test_html_marks():
    long = "the main text of this page"
    cases = {f"<{tag} class='no-sidebar {word}'><p>{long}</p></{tag}>": long for tag in ("html", "body", "main", "article") for word in ("comments-open", "form-page", "social")}
    cases |= {
        f"<div class='has-social'>{long}</div><div class='x Social'>go</div><div id=comments>go</div>": long,
        f"<div>{long}</div><article>teaser</article>": f"{long}\n\nteaser",
        f"<div>short</div><article>{long}</article>": long,
    }
    for page, text in cases.items():
        assert html.main_text(html.parse(page), ()) == text, page


def test_mixing(docs, empty):
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == len(TEXTS) and rows.probability.between(0, 1).all()
    cells = rows.fillna("null").groupby(["source", "lang", "topic"]).agg(tokens=("tokens", "sum"), w=("weight", "first")).reset_index()
    for d in mixing.DIMENSIONS:
        own = cells.groupby(d).agg(t=("tokens", "sum"), w=("w", "sum"))
        p = (own.t / own.t.sum()) ** mixing.EVENNESS[d]
        assert np.allclose(own.w, p / p.sum(), atol=1e-4)
    assert mixing.mix(empty).count() == 0
    kept = mixing.sample_mixture(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(rows.doc_id[rows.sampled])


def test_mixing_budget(spark):
    import corpus_pipeline

    rows = [(i, "a b c d e f g h i j" + " | k" * (i % 10 == 0), ["en", "fr", None][i % 7 % 3], f"s{i % 5 % 2}") for i in range(2000)]
    rows += [(2000, "x y z", "rare", "rare"), (2001, None, "fr", "s0"), (2002, "", "empty", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in corpus_pipeline.mixture(spark, df, "").collect()}  # one rare cell doesn't set the size
    share = corpus_pipeline.TOKEN_SHARE
    assert {2000, 2001, 2002} <= kept and abs(len(kept) / len(rows) - share) < 0.05
    for share in (0.3, share, 1.0):
        mixed = mixing.mix(df, share=share).toPandas()
        assert mixed.probability.between(0, 1).all() and np.isclose((mixed.tokens * mixed.probability).sum(), share * mixed.tokens.sum())
        own = mixed.fillna("null").assign(x=mixed.tokens * mixed.probability)
        for r in mixing.shares_reached(df, share).collect():
            assert np.isclose(own.x[own[r.dimension] == (r.value or "null")].sum() / own.x.sum(), r.reached)
            assert share == 1 or r.value in ("rare", "empty") or abs(r.reached - r.target) < 0.01
    assert mixing.mix(df.limit(0), share=0.5).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, BASE, "en", "a"), (1, BASE, "en", "a"), (None, "", "en", "a")], "doc_id long, text string, lang string, source string")
    for name in ("op1_language_id", "op2_exact_dedup", "op3_audio_features", "op4_ngram_jaccard", "op5_token_counts", "op6_license_scan", "op7_substring_dedup", "op8_bpe", "op10_source_mixing"):
        registered_table = registered.table
        try:
            registered.table = lambda *a: df
            assert registered.QUERIES[name](spark, "").count() == 3, name
        finally:
            registered.table = registered_table


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    d = docs.drop("kept", "n_words")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns
        before, after = {r.doc_id for r in d.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        if name == "language":
            assert before - after == {i for i, t in enumerate(TEXTS) if not any(c.isalpha() for c in t or "")}
        d = out
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() == d.count()
    docs.drop("kept", "n_words").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == d.count()
