"""The trained operators: held-out accuracy, formulas, and rows that are odd."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from odd_texts import TEXTS
from scoreframe.llm import contexts, gru, lm, toxicity
from scoreframe.llm.common import held
from scoreframe.llm.dom import blocks
from scoreframe.llm.extract import ChainField, extract_main_text, main_text, main_text_model
from scoreframe.llm.language import identify_language
from scoreframe.llm.lm import score_texts
from scoreframe.llm.pages import labelled_page
from scoreframe.llm.toxicity import score_toxicity


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


# ---------------------------------------------------------------- language


def test_language_of_held_out_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = identify_language(docs, ~held("doc_id", 3, 1)).join(docs, "doc_id").collect()
    apart = [r for r in rows if fold(r.doc_id, 3) == 1]
    assert sum(r.lang == r.lang_pred for r in apart) >= 0.97 * len(apart) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, nothing):
    rows = identify_language(odd, F.lit(True)).collect()
    assert len(rows) == len(TEXTS)
    found = {r.doc_id: r for r in rows}
    for i in (3, 4, 7):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert found[9].lang_pred == "fr" and found[5].lang_pred == "en"
    assert sorted(r.lang_pred for r in rows if r.doc_id is None)[1] == "und"
    assert {r.lang_pred for r in identify_language(odd, F.lit(False)).collect()} == {"und"}
    assert identify_language(nothing, F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        identify_language(odd, F.lit(True), most_languages=1)


def test_language_score_is_the_posterior(spark):
    rows = [(1, "aab", "x"), (2, "ab b", "x"), (3, "cc a", "y"), (4, "Abc", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        padded = [*text.lower(), " ", " "]
        return Counter(tuple(padded[i : i + n]) for i in range(len(text)) for n in (1, 2, 3))

    counts = {"x": grams("aab") + grams("ab b"), "y": grams("cc a")}
    log = {}
    for lang, own in counts.items():
        total = sum(own.values()) + 0.5 * 65536
        log[lang] = sum(n * math.log((own[g] + 0.5) / total) for g, n in grams("abc").items())
    expected = 1 / (1 + math.exp(min(log.values()) - max(log.values())))
    found = {r.doc_id: r for r in identify_language(frame, F.lit(True)).collect()}
    assert found[4].lang_pred == max(log, key=log.get)
    assert found[4].score == pytest.approx(expected, rel=1e-4)


# ---------------------------------------------------------------- language model


def test_base_score(spark, texts):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    # Few words sent, so that most are joined.
    rows = score_texts(frame, ~held("doc_id", 10, 0), most_sent=50).collect()
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [b" "] for i, t in texts.items()}
    counts = Counter(w for i, own in tokens.items() if fold(i, 10) for w in own)
    total, size = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens[r.doc_id]
        expected = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (size + 1))) for w in own)
        assert r.base_score == pytest.approx(expected, rel=1e-9)
        assert (r.n_tokens, r.train_tokens) == (len(own), total)
        assert r.n_known == sum(counts[w] > 0 for w in own)
    apart = [r for r in rows if not fold(r.doc_id, 10)]
    bits = -sum(r.score for r in apart) / math.log10(2)
    size = sum(len(texts[r.doc_id].encode()) + 1 for r in apart)
    assert bits / size < 3


def test_language_model_of_odd_rows(odd, nothing):
    rows = score_texts(odd, F.lit(True)).collect()
    assert len(rows) == len(TEXTS)
    found = {r.doc_id: r for r in rows}
    assert found[3].n_tokens == found[4].n_tokens == 1 and found[3].score == found[4].score < 0
    assert found[5].score == found[6].score
    assert all(r.n_known == r.n_tokens for r in rows)
    untaught = score_texts(odd, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in untaught} == {(0, 0)}
    assert score_texts(nothing, F.lit(True)).count() == 0


def exact_tree(samples, depth=0):
    """log2 P_w of one bit's tree from (context, bit) pairs, straight from the definition."""
    zeros, ones, own = 0, 0, 0.0
    for _, bit in samples:
        own += math.log2(((ones if bit else zeros) + 0.5) / (zeros + ones + 1))
        zeros, ones = zeros + (not bit), ones + bit
    if depth == contexts.DEPTH:
        return own
    inner = 0.0
    for byte in {context[depth] for context, _ in samples}:
        inner += exact_tree([s for s in samples if s[0][depth] == byte], depth + 1)
    top = max(own, inner)
    return top + math.log2(2 ** (own - top) + 2 ** (inner - top)) - 1


def byte_samples(texts):
    """(the five bytes before, the last first; the byte) of all bytes and ends of texts."""
    for text in texts:
        whole = bytes([contexts.START] * contexts.DEPTH) + text + bytes([contexts.END])
        for i in range(contexts.DEPTH, len(whole)):
            yield tuple(whole[i - contexts.DEPTH : i][::-1]), whole[i]


def test_context_tree_is_the_exact_mixture(spark):
    taught = ["abracadabra", "abrakadabra!", "", "Абвгабвг", "a cabra 12 12 12", None, "bra\nbra\tbra"]
    asked = ["abra", "", "cadabra 13", "абвг", "вг漢", "zzzz", None]
    rows = [(i, t) for i, t in enumerate([*taught, *asked])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    samples = list(byte_samples([(t or "").encode() for t in taught]))
    expected = {}
    for i, text in rows[len(taught) :]:
        total = 0.0
        for context, byte in byte_samples([(text or "").encode()]):
            for level in range(8):
                own = [(c, b >> (7 - level) & 1) for c, b in samples if b >> (8 - level) == byte >> (8 - level)]
                longer = [*own, (context, byte >> (7 - level) & 1)]
                total += exact_tree(longer) - exact_tree(own)
        expected[i] = total * math.log10(2)
    # All grams sent to the tasks, some of them, and none.
    for most in (1 << 21, 30, 0):
        found = score_texts(frame, F.col("doc_id") < len(taught), most_grams=most).collect()
        assert len(found) == len(rows)
        for row in found:
            if row.doc_id in expected:
                assert row.score == pytest.approx(expected[row.doc_id], rel=1e-6)


def test_trees_do_not_depend_on_the_cuts(spark, texts, monkeypatch):
    data = np.frombuffer("".join(texts.values()).encode()[:30000], np.uint8)
    keys, counts = np.unique(contexts.grams(data, np.array([0, len(data)])), return_counts=True)
    batches = [
        pa.RecordBatch.from_pydict({"key": k.view(np.int64), "n": n, "m": n})
        for k, n in zip(np.array_split(keys, 37), np.array_split(counts, 37))
    ]
    monkeypatch.setattr(lm, "CHUNK", 500)
    parts = list(lm._subtrees(iter(batches)))
    assert len(parts) > 5 and np.array_equal(np.concatenate([p[0] for p in parts]), keys)
    whole = contexts.subtrees(keys, counts)
    order = np.argsort(whole[0])
    top = [column[order] for column in whole]
    top = (top[0], *contexts.crown(*top))
    together = contexts.log_probabilities(keys, counts, top)
    apart = np.concatenate([contexts.log_probabilities(p[0], p[1], top) for p in parts])
    assert np.allclose(together, apart)
    # What may follow a context adds up to no more than one.
    _, context = np.unique(keys >> np.uint64(8), return_inverse=True)
    assert np.bincount(context, 10.0**together).max() <= 1 + 1e-9


def test_a_minority_script_costs_little(spark, texts):
    """A script of a small share of the training texts, against a model of it alone."""
    letters = {chr(97 + i): chr(0x430 + i) for i in range(26)}
    spelled = {i: "".join(letters.get(c, c) for c in t.lower()) for i, t in texts.items()}
    few = [i for i in texts if i % 20 == 3]
    test = [i for i in texts if i % 20 == 4][:40]
    rows = [(i, t) for i, t in texts.items() if i % 20 not in (3, 4)]
    rows += [(i, spelled[i]) for i in [*few, *test]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bits = []
    for taught in (~F.col("doc_id").isin(test), F.col("doc_id").isin(few)):
        scored = score_texts(frame.filter(taught | F.col("doc_id").isin(test)), taught)
        bits.append(sum(r.score for r in scored.filter(F.col("doc_id").isin(test)).collect()))
    assert bits[0] >= 1.1 * bits[1]


# ---------------------------------------------------------------- pages


def test_blocks_of_labelled_pages():
    for seed in range(200):
        page, labels = labelled_page(seed)
        assert len(list(blocks(page))) == len(labels)


def test_main_text_of_unseen_layouts():
    field = main_text_model()
    right = total = 0
    for seed in range(5000, 5200):
        page, labels = labelled_page(seed)
        right += sum(a == b for a, b in zip(field.decode(list(blocks(page))), labels))
        total += len(labels)
    assert right >= 0.98 * total


def test_viterbi_and_marginals_against_all_labellings():
    import itertools

    field = ChainField()
    rng = np.random.default_rng(4)
    field.pairs = rng.normal(size=(3, 2))
    page = list(blocks("<p>a<p>b<p>c<p>d"))
    unary = rng.normal(size=(4, 2))
    field.unary = lambda _: unary
    score = {
        y: field.pairs[2, y[0]] + sum(unary[i, y[i]] for i in range(4))
        + sum(field.pairs[y[i], y[i + 1]] for i in range(3))
        for y in itertools.product((0, 1), repeat=4)
    }
    assert tuple(field.decode(page)) == max(score, key=score.get)
    total = sum(map(math.exp, score.values()))
    chance, joint = field.marginals(unary)
    for i in range(4):
        assert chance[i, 1] == pytest.approx(sum(math.exp(s) for y, s in score.items() if y[i]) / total)
    pairs = sum(math.exp(s) * sum(y[i : i + 2] == (0, 1) for i in range(3)) for y, s in score.items())
    assert joint[0, 1] == pytest.approx(pairs / total)


def test_pages_of_the_test_data(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    import html

    for r in found:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in parts]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_odd_pages(spark):
    field = main_text_model()
    rows = [
        (1, None),
        (2, ""),
        (3, "<article><p>One &amp; two\n\t three.<p>Four<br>five <b>six</p></article"),
        (4, "<nav><a href=x>Menu</a></nav><script>var a = '<p>no</p>';"),
        (4, "<nav><a href=x>Menu</a></nav><script>var a = '<p>no</p>';"),
        (None, "<article><h1>Deep down</h1>" + "<div>" * 3000 + "<p>Here it goes on, with words.</p>"),
        (6, '<article><p title="a > b">Quoted &lt;tag&gt; stays.</p><!-- <p>no</p> --></article>'),
        (7, "<article><p>" + "Long and longer. " * 60000),
        (8, "< <a <" * 20000),
    ]
    frame = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' AS url", "1 AS text")
    found = extract_main_text(frame).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert texts[1] == texts[2] == texts[4] == ""
    assert texts[3] == "One & two three.\nFour five six"
    assert texts[None] == "Deep down\nHere it goes on, with words."
    assert texts[6] == "Quoted <tag> stays."
    assert texts[7] == ("Long and longer. " * 60000).strip()
    assert main_text(field, "") == ""
    assert extract_main_text(frame.filter("false")).count() == 0


# ---------------------------------------------------------------- toxicity


def test_gradients_of_the_network():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in gru.initial(3, seed=2).items()}
    word, sizes = np.array([0, 1, 2, 3]), np.array([2, 1, 3, 1])
    trigrams = rng.integers(0, 1 << gru.TRIGRAM_BITS, 7)
    ids, steps = np.array([[0, 1, 2, 3, 0], [2, 3, 1, 1, 1]]), np.array([5, 3])
    target = np.array([1.0, 0.0])

    def loss():
        logit = gru.forward(p, gru.embed(p, word, trigrams, sizes), ids, steps)
        return float(np.mean(np.log1p(np.exp(-np.where(target > 0, logit, -logit)))))

    found = gru.gradients(p, word, trigrams, sizes, ids, steps, target)
    for name, values in p.items():
        flat, slope = values.reshape(-1), found[name].reshape(-1)
        picked = np.argsort(-np.abs(slope))[:4]
        for i in picked:
            kept, step = flat[i], 1e-3
            flat[i] = kept + step
            above = loss()
            flat[i] = kept - step
            below = loss()
            flat[i] = kept
            assert slope[i] == pytest.approx((above - below) / (2 * step), abs=2e-4), name


def test_windows_cover_every_word():
    for many in (0, 1, 31, 32, 33, 56, 57, 200):
        first, size, owner = gru.windows(np.array([0, many]), 32, 24)
        covered = {i for f, s in zip(first, size) for i in range(f, f + s)}
        assert covered == set(range(many)) and all(s <= 32 for s in size)


def test_every_window_lies_in_one_segment():
    for many in (0, 1, 31, 32, 33, 127, 128, 129, 225, 226, 1000, 98765):
        first, size, _ = gru.segments(np.array([0, many]), 32, 128)
        assert all(0 < s <= 128 for s in size)
        if many < 32:
            assert list(zip(first, size)) == [(0, many)] * (many > 0)
        else:
            begins = [f + i for f, s in zip(first, size) for i in range(s - 31)]
            assert begins == list(range(many - 31))


INSULTS = ["grumblefink", "snotwaddle", "nitwhistle"]


def toxic_rows(count, seed, low=20, high=300):
    import random

    r = random.Random(seed)
    words = [f"{a}{b}" for a in "ka lo mi ne ru sa to vi".split() for b in "ban dor fel gim hus".split()]
    rows = []
    for i in range(count):
        own = r.choices(words, k=r.randint(low, high))
        if i % 3 == 0:
            for _ in range(r.randint(1, 3)):
                own.insert(r.randrange(len(own)), r.choice(INSULTS).upper() + r.choice(["", "!", ","]))
        rows.append((seed * 10_000 + i, " ".join(own), int(i % 3 == 0)))
    return rows


def test_toxicity_of_held_out_documents(spark):
    rows = toxic_rows(400, 1) + toxic_rows(20, 2, 4000, 6000)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2], "x") for r in rows], "doc_id long, toxic int, text string")
    scored = score_toxicity(docs, labels, ~held("doc_id", 5, 0)).collect()
    truth = {r[0]: r[2] for r in rows}
    apart = [r for r in scored if fold(r.doc_id, 5) == 0 or r.doc_id >= 20_000]
    right = [(r.toxicity >= 0.5) == bool(truth[r.doc_id]) for r in apart]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r.toxicity <= 1 for r in scored)


def plain_logits(p, inputs, width):
    """The logits of a segment's windows, a step and a unit at a time."""
    size = gru.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    states = []
    for d in (0, 1):
        hidden, found = np.zeros(size), []
        for x in inputs if d == 0 else inputs[::-1]:
            given, own = x @ p["input"][d] + p["bias"][d], hidden @ p["state"][d]
            update, reset = (sigmoid(given[k : k + size] + own[k : k + size]) for k in (0, size))
            fresh = np.tanh(given[2 * size :] + reset * own[2 * size :])
            hidden = (1 - update) * fresh + update * hidden
            found.append(hidden)
        states.append(found if d == 0 else found[::-1])
    both = [np.concatenate(pair) for pair in zip(*states)]
    weights = np.array([np.exp((np.tanh(h @ p["attend"]) @ p["weigh"])[0]) for h in both])
    for begin in range(max(1, len(both) - width + 1)):
        part = slice(begin, begin + width)
        pooled = sum(w * h for w, h in zip(weights[part] / weights[part].sum(), both[part]))
        yield float((pooled @ p["out"])[0] + p["base"][0])


def test_scores_are_those_of_a_plain_network_over_all_windows():
    model = toxicity.train([(r[2], r[1]) for r in toxic_rows(60, 5, 10, 30)])
    p, vocabulary = model["parameters"], model["vocabulary"]
    texts = [r[1] for r in toxic_rows(12, 6, 1, 400)] + ["One", "", "  two\nWORDS "]
    expected = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        data, starts, ends, _, value = gru.tokens(data, np.array([0, len(data)]))
        if not len(value):
            expected.append(float("nan"))
            continue
        inputs = []
        for start, end, hashed in zip(starts, ends, value):
            word = bytes(data[start:end])
            padded = b"\0" + word + b"\0"
            codes = [int.from_bytes(padded[i : i + 3], "big") + 1 for i in range(len(word))]
            grams = [(c * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - gru.TRIGRAM_BITS) for c in codes]
            place = np.searchsorted(vocabulary, hashed)
            known = place < len(vocabulary) and vocabulary[place] == hashed
            own = p["word"][place + 1 if known else 0]
            inputs.append(np.concatenate([own, p["char"][grams].mean(axis=0)]).astype(np.float64))
        first, size, _ = gru.segments(np.array([0, len(inputs)]), toxicity.WIDTH, toxicity.SEGMENT)
        parts = [inputs[f : f + n] for f, n in zip(first, size)]
        expected.append(max(max(plain_logits(p, part, toxicity.WIDTH)) for part in parts))
    found = gru.text_logits(model, pa.array(texts), toxicity.WIDTH, toxicity.SEGMENT)
    assert found == pytest.approx(expected, abs=1e-4, nan_ok=True)


def test_toxicity_of_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (8, None)], "doc_id long, toxic int")
    rows = score_toxicity(odd, labels, F.lit(True))
    assert rows.columns == [*odd.columns, "toxicity"]
    found = rows.collect()
    assert len(found) == len(TEXTS) and all(0 <= r.toxicity <= 1 for r in found)
    assert {r.toxicity for r in found if r.doc_id in (3, 4, 7)} == {0.0}
    unlabelled = score_toxicity(odd, labels.filter("false"), F.lit(True)).collect()
    assert {r.toxicity for r in unlabelled if r.doc_id in (1, 2, 5)} == {0.5}
    assert score_toxicity(nothing, labels, F.lit(True)).count() == 0


def test_scores_do_not_depend_on_the_neighbours():
    model = toxicity.train([(r[2], r[1]) for r in toxic_rows(60, 3, 10, 30)])
    values = [r[1] for r in toxic_rows(30, 4)]
    together = toxicity.scores(model, pa.array(values))
    alone = [toxicity.scores(model, pa.array([v]))[0] for v in values]
    assert np.allclose(together, alone, atol=1e-4)
