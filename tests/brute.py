"""Metrics written row by row from their formulas, as an independent check."""

import json
import math
import re


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = (
                table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            )
    return table[-1][-1]


def ratio(a, b):
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return round(100 * (2 * lcs(a, b) / (len(a) + len(b)))) / 100


def f1(common, got, want):
    if not common:
        return 0.0
    precision, recall = common / got, common / want
    return 2 * precision * recall / (precision + recall)


def sets(got, want, both):
    if not got and not want:
        return 1.0
    return both(got, want) if got and want else 0.0


def exact_match(p, r):
    return float(p.strip() == r.strip())


def exact_match_figure(p, r):
    try:
        return float(float(p.strip()) == float(r.strip()))
    except ValueError:
        return 0.0


def contains_answer(p, r):
    return float(r.strip() in p.strip())


def set_f1(p, r, delimiter="\n"):
    got = {part.strip() for part in p.split(delimiter)} - {""}
    want = {part.strip() for part in r.split(delimiter)} - {""}
    return sets(got, want, lambda g, w: f1(len(g & w), len(g), len(w)))


def char_f1(p, r):
    def form(text):
        text = "".join(c for c in text if not 0x80 <= ord(c) <= 0xFF)
        return " ".join(sorted(re.sub(r"\W", " ", text).lower().split()))

    return ratio(form(p), form(r))


def fuzzy_match(p, r, match_threshold=0.8):
    value = ratio(p.strip(), r.strip())
    return 1.0 if value >= match_threshold else value


def bleu(p, r):
    def tokens(text):
        text = text.strip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
        for escape, plain in [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
            text = text.replace(escape, plain)
        text = " " + text + " "
        text = re.sub(r"""([{|}~\[\\\]^_` !"#$%&()*+:;<=>?@/])""", r" \1 ", text)
        text = re.sub(r"([^0-9])([.,])", r"\1 \2 ", text)
        text = re.sub(r"([.,])([^0-9])", r" \1 \2", text)
        return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()

    got, want = tokens(p), tokens(r)
    precisions, smooth = [], 1.0
    for n in range(1, 5):
        grams = [tuple(got[i : i + n]) for i in range(len(got) - n + 1)]
        target = [tuple(want[i : i + n]) for i in range(len(want) - n + 1)]
        if not grams:
            return 0.0
        hits = sum(min(grams.count(g), target.count(g)) for g in set(grams))
        if n == 1 and not hits:
            return 0.0
        if not hits:
            smooth *= 2
        precisions.append(hits / len(grams) if hits else 1 / (smooth * len(grams)))
    brevity = 1.0 if len(got) >= len(want) else math.exp(1 - len(want) / len(got))
    return brevity * math.prod(precisions) ** 0.25


def rouge_l(p, r):
    got, want = p.lower().split(), r.lower().split()
    return f1(lcs(got, want), len(got), len(want)) if got and want else 0.0


def jaccard_similarity(p, r):
    got, want = set(p.lower().split()), set(r.lower().split())
    return sets(got, want, lambda g, w: len(g & w) / len(g | w))


def word_count_similarity(p, r):
    got, want = len(p.split()), len(r.split())
    return sets(got, want, lambda g, w: 1 - abs(g - w) / max(g, w))


def length_ratio(p, r):
    return sets(len(p), len(r), lambda g, w: min(g / w, w / g))


def weighted_match(p, r, weight=0.5, case_sensitive=False):
    if not case_sensitive:
        p, r = p.lower(), r.lower()
    return weight if p.strip() == r.strip() else 0.0


def composite(p, r):
    return 0.3 * exact_match(p, r) + 0.4 * char_f1(p, r) + 0.3 * set_f1(p, r)


def json_validity(p, r):
    try:
        got, want = json.loads(p), json.loads(r)
    except ValueError:
        return 0.0
    if not isinstance(got, dict) or not isinstance(want, dict):
        return 0.0
    if not want:
        return float(not got)
    return len(got.keys() & want.keys()) / len(got.keys() | want.keys())
