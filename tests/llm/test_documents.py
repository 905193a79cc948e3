"""Operators that treat each document by itself, against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webstrata.llm import boosting, language, main_text, packing, piece_trie, quality, token_output, toxicity
from webstrata.llm.common import crc_of, quantiles, tokenizer_path
from webstrata.llm.vocabulary import WordEncoder

WORD_BPE, PIECES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \n\t ", "a", "Don't it's 'S x's,", "<|endoftext|> <|ENDOFTEXT|>b, c", "a.b, c... d,. e\".", "日本語、テスト。 한국어", "İstanbul, ß ﬁx.",
       "x y", "  the   cat  ", "é́ 🎉🎉\x00", "z" * 5000, "word " * 3000]


def documents(spark, texts):
    """The texts, two of them twice under one id, one without id, and columns whose names the operators use."""
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(3, "a", "en", "s", 1), (3, "other", None, None, None), (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("quality", "language", "score", "kept", "word", "n", "segment", "rep")})


def expected_ids(text, end):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids + [end]


def test_variable_length_code():
    rng = np.random.default_rng(1)
    for numbers in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], rng.integers(0, 70_000, 10_001), [3] * 7):
        control, data = token_output.encode_block(np.array(numbers, np.uint64))
        assert token_output.decode_block(control, data, len(numbers)).tolist() == list(numbers) and len(control) == -(-len(numbers) // 4)


def test_word_encoder_agrees_with_the_library():
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("aA,.'́ é\n\t<|İx1½") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    coder = WordEncoder(WORD_BPE, limit=100)
    for part in (texts[:200], texts[200:]):
        ids, counts = coder.encode([t.encode() for t in part], 2)
        ends = np.cumsum(counts)
        assert [ids[b - c:b].tolist() for b, c in zip(ends, counts)] == [expected_ids(t, 2) for t in part]


def test_token_files(spark):
    docs = documents(spark, ODD)
    blocks, ranked = token_output.write_token_files(docs, WORD_BPE, 2)
    got = sorted(token_output.read_token_files(blocks, ranked).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    by_id = defaultdict(list)
    for r in docs.collect():
        by_id[r.doc_id].append(expected_ids(r.text, 2))
    for r in got:
        assert r.ids in by_id[r.doc_id] and r.ids_crc32 == crc_of(np.array(r.ids)) and r.n_tokens == len(r.ids)
    counts = Counter(i for r in got for i in r.ids)
    assert [counts[i] for i in ranked] == sorted(counts.values(), reverse=True)
    assert token_output.token_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_windows_are_full(seed):
    rng = random.Random(seed)
    packer, total = packing.Packer(), 0
    sizes = [rng.choice([1, 5, 200, 256, 300, 900, 1024, 2048, 5000]) for _ in range(400)]
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n))
        total += n
        if k % 150 == 149:
            packer.pack()
    packer.pack(last=True)
    windows = packer.take()
    short = [w for context, w in windows if sum(len(p[2]) for p in w) < context]
    assert len(short) <= 1 and all(sum(len(p[2]) for p in w) <= c for c, w in windows)
    seen = defaultdict(list)
    for _, window in windows:
        for doc, start, ids, n in window:
            assert n == sizes[doc] and ids.tolist() == list(range(start, start + len(ids)))
            seen[doc] += ids.tolist()
    assert all(sorted(seen[k]) == list(range(n)) for k, n in enumerate(sizes)) and sum(map(len, seen.values())) == total


def test_packing(spark):
    docs = documents(spark, ODD)
    pieces = packing.pack_documents(docs, WORD_BPE, 1, keep_ids=True).collect()
    by_window, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_window[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids) > 0
    for window in by_window.values():
        window.sort(key=lambda p: p.offset)
        assert [p.offset for p in window] == [sum(x.length for x in window[:k]) for k in range(len(window))] and sum(p.length for p in window) <= 2048
    for k in (0, 1, 2, 7, 12, 13):
        assert [i for p in sorted(by_doc[k], key=lambda p: p.start) for i in p.ids] == expected_ids(ODD[k], 1)
    assert sum(p.length for p in pieces) == sum(len(expected_ids(r.text, 1)) for r in docs.collect())
    assert packing.pack_documents(docs.limit(0), WORD_BPE, 1).count() == 0
    group = packing.deal([9, 1, 5, 5, 2, 8], 3)
    assert sorted(group.tolist()) == [0, 0, 1, 1, 2, 2] and {sum(w for w, g in zip([9, 1, 5, 5, 2, 8], group) if g == k) for k in range(3)} == {10}


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    covered = {j for k, w in enumerate(windows) if often[w] > 1 for j in (k, k + 1, k + 2)}
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_quality(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "one", "two", "three"]) + str(rng.randint(0, 500)) for _ in range(80)) for _ in range(60)]
    texts = ODD + good + [g.upper().replace(" ", "!! ") for g in good] + ["a b c d\na b c d\n" * 20]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k < len(ODD) + 60), 0) for k in range(len(ODD), len(ODD) + 120, 2)] + [(None, 1, 0), (9999, 1, 0), (20, None, 0)],
                                   "doc_id long, quality int, toxic int")
    trees = quality.fit(docs, labels)
    rows = quality.judge(docs, trees).select("doc_id", "text", "quality.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = plain_counts(r.text)
        assert [r[c] for c in quality.BASE] == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert set(range(len(ODD), len(ODD) + 60)) <= kept and not kept & set(range(len(ODD) + 60, len(ODD) + 120))
    assert quality.kept(docs, trees).columns == docs.columns and quality.kept(docs, trees).count() == len([r for r in rows if r.kept])
    plain = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.kept(docs, plain).count() == sum(not r.base_failed for r in rows)


def test_all_labels_are_learnt(spark):
    n = 21_000
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(400)))
    marks = F.array_repeat(F.lit("#"), F.pmod(F.xxhash64("id"), F.lit(30)).cast("int"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(word(k) for k in range(50)), F.concat_ws("", marks)).alias("text"))
    labels = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 9, None).otherwise((F.length(F.concat_ws("", marks)) < F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(30))).cast("int")).alias("quality"))
    trees = quality.fit(docs, labels)
    seen = docs.join(labels, "doc_id").where("quality IS NOT NULL").select("quality", quality.statistics_of("text").alias("s")).select("quality", "s.*").toPandas()
    want = boosting.fit_trees(seen[list(quality.FEATURES)].to_numpy(float), seen["quality"].to_numpy(float), np.array(list(quality.FEATURES.values())))
    assert np.array_equal(trees.feature, want.feature) and np.allclose(trees.threshold, want.threshold, rtol=1e-12) and np.allclose(trees.leaf, want.leaf)


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    made = [(k, float(v), int(t)) for k in (0, 1, 5) for v, t in zip(rng.integers(0, 40, 500) / 7 if k else rng.random(500), rng.integers(1, 4, 500))] + [(6, 2.5, 1)]
    shares = [0.0, 0.01, 1 / 3, 0.5, 0.97, 1.0]
    got = quantiles(spark.createDataFrame(made, "key int, value double, times long").repartition(7), shares)
    assert set(got) == {0, 1, 5, 6} and quantiles(spark.createDataFrame([], "key int, value double, times long"), shares) == {}
    for key, found in got.items():
        assert np.allclose(found, np.quantile(np.repeat(*zip(*[(v, t) for k, v, t in made if k == key])), shares), rtol=1e-12)


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((np.sin(9 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.3, 2000)) > 0.8).astype(float)
    trees = boosting.fit_trees(x, y, np.array([0, 1, -1]))
    grid = np.linspace(0, 1, 101)
    for f, sign in ((1, 1), (2, -1)):
        for row in x[:50]:
            line = np.repeat(row[None], 101, axis=0)
            line[:, f] = grid
            assert (sign * np.diff(trees.score(line)) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.85
    assert boosting.fit_trees(x[:0], y[:0], np.zeros(3)).score(x[:2]).tolist() == [0.5, 0.5]


def plain_likelihood(vocab, chances, word):
    marked, known = "▁" + word, {p: k for k, p in enumerate(vocab.pieces)}
    forward = np.zeros((len(marked) + 1, chances.shape[1]))
    forward[0] = 1
    for end in range(1, len(marked) + 1):
        for start in range(end):
            piece = marked[start:end]
            if piece in known or end - start == 1:
                forward[end] += forward[start] * chances[known.get(piece, len(known))]
    return np.log(forward[-1])


def test_segmentations_are_summed():
    vocab = language.vocabulary(PIECES)
    chances = np.random.default_rng(1).random((len(vocab) + 1, 2))
    chances /= chances.sum(axis=0)
    words = ["the", "a", "thing", "çédille", "日本", "zzzzz", "straße", "x" * 40, "日本語" * 9, "hi" * 25, "हिन्दी"]
    with np.errstate(over="ignore"):
        assert np.allclose(language.log_likelihood(vocab, chances, words), [plain_likelihood(vocab, chances, w) for w in words])
        uses = language.expected_counts(vocab, chances[:, 0], ["the"], np.array([2.0]))
    letters = sum(u * (len(vocab.pieces[k]) if k < len(vocab) else 1) for k, u in enumerate(uses))
    assert letters == pytest.approx(8)


def test_language(spark):
    kinds = {"en": "the house of the people and this thing with that", "de": "das haus der leute und diese sache mit einer", "fr": "la maison des gens et cette chose avec une"}
    rng = random.Random(5)
    made = [(n, " ".join(rng.choice(w.split()) for _ in range(12))) for n, w in kinds.items() for _ in range(30)]
    docs = spark.createDataFrame([(k, t, n, "s", 1) for k, (n, t) in enumerate(made)] + [(1000, None, "en", "", 0), (1001, "12 !", "en", "", 0), (1002, "x", None, "", 0),
                                                                                          (1003, "the " * 9000, None, "", 0), (None, "das haus", "de", "", 0)], DOCS)
    model = language.fit(docs.where("coalesce(doc_id, 0) % 3 <> 1"), PIECES)
    rows = language.identify(docs, model, PIECES).select("doc_id", "lang", "language.*").collect()
    got = {r.doc_id: r for r in rows}
    assert sum(got[k].lang_pred == n for k, (n, _) in enumerate(made)) >= 88 and (got[1000].lang_pred, got[1001].lang_pred) == ("und", "und")
    assert all(0 <= r.score <= 1 for r in rows) and got[1003].lang_pred == "en" and got[None].lang_pred == "de" and len(rows) == docs.count()
    assert language.kept(docs, model, PIECES).columns == docs.columns and language.kept(docs, model, PIECES).where("doc_id IN (1000, 1001)").count() == 0
    nothing = language.fit(docs.limit(0), PIECES)
    assert {r.lang_pred for r in language.identify(docs, nothing, PIECES).select("language.*").collect()} == {"und"}


def test_all_documents_of_a_language_are_learnt(spark):
    rng = random.Random(8)
    made = [("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) + " house", n) for n in ("en", "de") for _ in range(5000 if n == "en" else 50)]
    model = language.fit(spark.createDataFrame([(k, t, n, "s", 1) for k, (t, n) in enumerate(made)], DOCS), PIECES, rounds=2)
    whole = [(k, " ".join(t for t, lang in made if lang == n), n, "s", 1) for k, n in enumerate(("en", "de"))]  # the same words in one document
    assert np.allclose(model.chances, language.fit(spark.createDataFrame(whole, DOCS), PIECES, rounds=2).chances, rtol=1e-9)
    fits = []
    with np.errstate(over="ignore"):
        vocab = language.vocabulary(PIECES)
        for t, n in made:
            if n == "en":
                words = t.split()
                fits.append((language.log_likelihood(vocab, model.chances, words)[:, 1].sum() / sum(len(w) + 1 for w in words), sum(len(w) + 1 for w in words)))
    middle, low = np.quantile(np.repeat(*zip(*fits)), [0.5, language.LOW])
    assert model.names == ["de", "en"] and model.floor[1] == pytest.approx(middle - np.clip(language.TIMES * (middle - low), -language.LEAST * middle, -language.MOST * middle))


def test_language_not_learnt(spark):
    kinds = {"en": "the house of the people and this thing with that which they have seen before", "de": "das haus der leute und diese sache mit einer von ihnen gesehen",
             "fr": "la maison des gens et cette chose avec une qui nous avons vue"}
    other = {"fi": "talo ja ihmiset joita olemme nähneet tämän asian kanssa ennen kuin he tulivat", "pl": "dom ludzi oraz rzecz którą widzieliśmy przedtem gdy przyszli"}
    rng = random.Random(6)
    text = lambda w: " ".join(rng.choice(w.split()) for _ in range(60))
    letters = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60))
    clean = [(text(w), n) for n, w in kinds.items() for _ in range(40)]
    foreign = [(text(w), lang) for w in other.values() for lang in (None, None, None)] + [(letters(), lang) for lang in (None, None, "en")] + [("привет как дела " * 20, None)]
    docs = spark.createDataFrame([(k, t, n, "s", 1) for k, (t, n) in enumerate(clean + foreign)] + [(None, text(kinds["de"]), None, "s", 1)], DOCS)
    model = language.fit(docs, PIECES)
    assert sorted((r.doc_id for r in language.kept(docs, model, PIECES).collect()), key=str) == sorted([*range(len(clean)), None], key=str)
    assert {r.lang_pred for r in language.identify(docs, model, PIECES).select("language.*").collect()} == set(kinds)


def test_long_words_do_not_underflow():
    vocab = language.vocabulary(PIECES)
    chances = np.random.default_rng(1).random((len(vocab) + 1, 2))
    chances /= chances.sum(axis=0)
    with np.errstate(over="ignore"):
        short, long = language.log_likelihood(vocab, chances, ["ab" * 500, "ab" * 50_000])
        uses = language.expected_counts(vocab, chances[:, 0], ["ab" * 2000], np.array([3.0]))
    assert np.isfinite(long).all() and np.allclose(long / short, 100, rtol=0.05)
    assert sum(u * (len(vocab.pieces[k]) if k < len(vocab) else 1) for k, u in enumerate(uses)) == pytest.approx(3 * 4001)


def test_words_are_letters_and_their_marks():
    assert language.words_of("½ ² Ⅷ 7 हिन्दी é x̄y \u0301 a1b".encode()) == ["हिन्दी", "é", "x̄y", "a", "b"]


def test_every_language_is_learnt(spark):
    docs = spark.createDataFrame([(k, f"the house of number {chr(97 + k % 26) * 9} {chr(0x3b1 + k // 26) * 9}", f"l{k:03}", "s", 1) for k in range(600)], DOCS)
    docs = docs.withColumn("language", F.lit(7))
    model = language.fit(docs, PIECES, rounds=1)
    assert len(model.names) == 600
    found = language.identify(docs.where("doc_id IN (3, 599)"), model, PIECES, "found").select("lang", "found.lang_pred", "language").collect()
    assert all(r.lang == r.lang_pred and r.language == 7 for r in found)


def test_short_and_mixed_pages():
    assert main_text.main_text("<article><p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn></math> be a number, and so on for all the other words of this one.</p></article>").startswith("Let x+1 be")
    assert main_text.main_text("<article><p>Plain words &am<b>p;</b> more of them, R&amp;D and so on until the end of it.</p></article>").startswith("Plain words &amp; more of them, R&D")


def test_toxicity(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows, labels = [], []
    for k in range(1800):
        toxic = k % 6 == 0
        text = [rng.choice(words) for _ in range(40)] + ["Foulword," if k // 12 % 2 else "vileword"] * toxic
        rng.shuffle(text)
        rows.append((k, " ".join(text), "en", "s", 1))
        if k % 5 == 0:
            labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(9001, None, None, None, 0), (9002, "", None, None, 0), (None, "foulword", None, None, 0)], DOCS)
    marks = spark.createDataFrame(labels + [(0, 1, 0), (9003, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    train = "coalesce(doc_id, 0) % 4 <> 2"
    model = toxicity.fit(docs.where(train), marks.where(train))
    got = {r.doc_id: r.made for r in docs.select("doc_id", toxicity.scored(F.col("text"), model).alias("made")).collect()}
    wrong = [k for k in range(1800) if k % 4 == 2 and got[k].predicted != int(k % 6 == 0)]
    assert not wrong and got[None].predicted == 1 and got[9001] == got[9002] and 0 <= got[9002].score < 0.3
    assert toxicity.fit(docs, marks.limit(0)).score(b"foulword") < 1e-9 and toxicity.fit(docs.limit(0), marks).score(b"x") < 0.5


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div id="cookie-notice">We use cookies on this site, as all the others do, and you may read why. <a href=/c>Why</a></div><div class="ad">Buy now</div>
%s<section class="comments"><p>I read this and I do not agree with a word of what is written here.</p></section><aside>More</aside>
<form><label>Mail</label><input></form><script>var a = "</p><article>no</article>";</script><footer>&copy; me &middot; you</footer></body></html>"""


@pytest.mark.parametrize("inner, text", [
    ("<article><header><h1>Head &amp; more</h1></header><p>One  two\n three.<p>A.<p>Four<br>five<br><br>six &lt;x&gt;</article>", "Head & more\nOne two three.\nA.\nFour five\nsix <x>"),
    ("<main><p><b>Un<i>closed</b> markup<p title='a > b'>kept &am</main>", "Unclosed markup\nkept &am"),
    ("<div class='entry-content'><h2>Title</h2><ul><li>x<li>y</ul><table><tr><td>c<td>d</table></div>", "Title\nx\ny\nc\nd")])
def test_main_text(inner, text):
    assert main_text.main_text(PAGE % inner) == text
    assert main_text.main_text((PAGE % inner).split("</article>")[0].split("</main>")[0]).startswith(text.split("\n")[0])


@pytest.mark.parametrize("attributes, seen", [
    ('style="overflow:hidden"', True), ("style='color:red; overflow: hidden'", True), ('title="The hidden city"', True), ("data-state=hidden", True),
    ('data-x="a hidden b" aria-hidden="false"', True), ('class="hidden md:block"', True), ('class="overflow-hidden"', True), ('style="display:none; display:block"', True),
    ('style="background:url(x;display:none)"', True), ('style="backface-visibility:hidden"', True), ('title="display:none"', True), ('title="aria-hidden=true"', True),
    ("hidden", False), ("class=x hidden", False), ('HIDDEN=""', False), ("aria-hidden=true", False), ('style="color:red;DISPLAY : none"', False),
    ('style="display:none!important;display:block"', False), ('style="visibility:hidden"', False)])
@pytest.mark.parametrize("tag", ["article", "main", "div", "p"])
def test_main_text_skips_what_is_hidden_only(tag, attributes, seen):
    words = " ".join(f"word{k}" for k in range(40))
    inner = words if tag == "p" else f"<p>{words}</p>"
    assert main_text.main_text(f"<body><{tag} {attributes}>{inner}</{tag}></body>") == words * seen


def test_main_text_seen_again():
    words = " ".join(f"word{k}" for k in range(40))
    assert main_text.main_text(f'<article style="visibility:hidden"><p>no {words}</p><div style="visibility:visible"><p>{words}</p></div></article>') == words


def prose(n, name="word"):
    return " ".join(f"{name}{k}" for k in range(n))


SHORT_AND_LONG = f"<h2>Short</h2><p>{prose(50)}</p><p>A few words only here</p><p>{prose(60)}</p>"
ALL_OF_IT = f"Short\n{prose(50)}\nA few words only here\n{prose(60)}"


@pytest.mark.parametrize("before, after", [
    ("<div class='content has-sidebar'>", "</div>"), ("<main><div class='elementor-widget-container'>", "</div></main>"), ("<form id=aspnetForm><div id=content>", "</div></form>"),
    ("<div id=page class=search-enabled><article>", "</article></div>"), ("<form id=aspnetForm><main>", "</main></form>"), ("<form><article>", "</article></form>"),
    ("<div class=widget><article>", "</article></div>"), ("<div class=sidebar><div class=entry-content>", "</div></div>"), ("<div class=related><main>", "</main></div>")])
def test_main_text_resets_marks(before, after):
    page = "<body><nav><a href=/>Home</a></nav>%s<div class=sidebar><p>About me and nothing else</p></div><footer>me</footer>"
    assert main_text.main_text(page % (before + SHORT_AND_LONG + after)) == ALL_OF_IT


def test_main_text_of_marked_containers():
    side, body, more = prose(80, "side"), f"<p>{prose(70)}</p>" * 2, prose(80, "other")
    page = f"<body><div>{body}</div><div class=%s><p>{side}</p><p>short one</p><p><a href=/x>{more}</a></p></div>"
    for word in ("sidebar", "widget", "search"):  # the numbers decide
        assert main_text.main_text(page % word) == f"{prose(70)}\n{prose(70)}\n{side}"
    for word in ("comments", "comment-list", "related-posts"):
        assert main_text.main_text(page % word) == f"{prose(70)}\n{prose(70)}"
    assert main_text.main_text(f"<body>{body}<aside><p>{side}</p></aside><footer><p>{side}</p></footer>") == f"{prose(70)}\n{prose(70)}"
    assert main_text.main_text(f"<article>{body}<section class=comments><article><p>{side}</p></article></section></article>") == f"{prose(70)}\n{prose(70)}"
    assert main_text.main_text(f"<form id=aspnetForm>{SHORT_AND_LONG.replace('<p>A few words only here</p>', '')}</form>").endswith(f"{prose(50)}\n{prose(60)}")


def test_main_text_links():
    two = f"<p>{prose(50)}</p><p>{prose(60)}</p>"
    for anchor in ("<a name=top>", "<a id=x class=href>", "<p><a href=/x>never closed</p>", "<ul><li><a href=/x>never closed<li>next</ul>", "<a href=/x>closed by<a name=y>"):
        blocks = main_text.blocks_of(f"<body>{anchor}{two}")
        assert [b.links for b in blocks[-2:]] == [0, 0], anchor
    assert [b.links for b in main_text.blocks_of("<a href=/x><div>in</div><p>all</p></a><p>out</p>")] == [1, 1, 0]


def test_main_text_tree_agrees_with_its_table():
    table = np.array([[float(v) for v in row.split()] for line in main_text.LABELLED.split("\n") for row in line.split("|") if row.strip()])
    assert (main_text.classify(main_text.tree(), table[:, :-1]) == table[:, -1]).all()


def test_main_text_of_any_page(spark):
    long = " ".join(f"w{k}" for k in range(50_000))
    pages = [None, "", "plain words only, but enough of them to be a text of its own", "<", "<p", "<p>a <b", "<p title='x>never closed</p>" + "<p a=b>" * 3000,
             "<div>" * 3000 + "deep" + "</div>" * 3000, f"<article><p>{long}</article>", "<!-- <p>x", "<script>x"]
    df = spark.createDataFrame([(k, f"u{k}", p, 1) for k, p in enumerate(pages)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.made for r in df.select("page_id", main_text.extracted(F.col("html")).alias("made")).collect()}
    assert [got[k].text for k in (0, 1, 9, 10)] == [""] * 4 and got[2].text == pages[2] and got[8].text == long and got[8].n_chars == len(long)


def library(path):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.mark.parametrize("unigram", [False, True])
def test_piece_trie_agrees_with_the_library(tmp_path, unigram):
    path = PIECES
    if unigram:
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(PIECES, "rb") as file:
            model.ParseFromString(file.read())
        model.trainer_spec.model_type = 1
        rng = random.Random(2)
        for p in model.pieces:  # no two paths of one score
            if p.type == 1:
                p.score = -rng.uniform(3, 12)
        path = str(tmp_path / "unigram.model")
        with open(path, "wb") as file:
            file.write(model.SerializeToString())
    rng = random.Random(1)
    texts = [t for t in ODD if t and len(t) < 5000 and "\x00" not in t] + ["".join(rng.choice(" ▁ab.\nthe日🎉é1") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += ["the thing that they thought there", "nothing another this breath " * 5]
    coder, sp = piece_trie.PieceEncoder(path), library(path)
    ids, counts = coder.ids_of([t.encode() for t in texts])
    ends = np.cumsum(counts)
    for t, b, c in zip(texts, ends, counts):
        assert ids[b - c:b].tolist() == sp.encode(t), t
        assert coder.model.decode(ids[b - c:b].tolist()) == sp.decode(ids[b - c:b].tolist())


def test_pieces(spark):
    docs = documents(spark, ODD)
    got = piece_trie.piece_digest(docs, PIECES).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got) and {r.n_ids for r in got if r.doc_id in (0, 1)} == {0}
    both = docs.select("text", piece_trie.encoded(F.col("text"), PIECES)["ids"].alias("ids")).select("text", "ids", piece_trie.decoded(F.col("ids"), PIECES).alias("back"))
    assert all((r.text or "") == r.back for r in both.collect()) and piece_trie.piece_digest(docs.limit(0), PIECES).count() == 0
