import math
import random
import re
from collections import Counter

from diffcorpus.llm import licenses
from diffcorpus.llm.license_texts import BASE, STOP, TEMPLATES


def test_all_templates_in_one_file_and_a_notice_in_long_prose(docs):
    """Other licences, or rarer words of the prose, take no votes away."""
    every = " and then some more ".join(t.text for t in TEMPLATES)
    prose = "purpose charge merge documentation copies provided granted conditions compliance unencumbered domain affero mozilla fee sublicense redistribute "
    rows = [(0, every), (1, prose * 300 + TEMPLATES[0].text + " " + prose * 300)] + [(i, f"license file {i}: software license") for i in range(2, 12)]
    got = {r.doc: r for r in licenses.scan(docs(rows)).collect()}
    assert {t.name for t in TEMPLATES} <= set(got[0].labels.split(",")) and got[0].score == 1.0
    assert got[1].labels == "mit,mit-notice" and got[1].score == 1.0
    assert all(got[i].labels == "" for i in range(2, 12))


def test_inserted_words_and_near_misses(docs):
    text = {t.name: t.text for t in TEMPLATES}
    numbered = text["bsd-text"].replace("met: Redistributions", "met: 1. Redistributions")
    assert numbered != text["bsd-text"]
    isc = text["isc-text"]
    rows = [
        (0, numbered),
        (1, isc),
        (2, isc.replace("with or without fee", "with and minus fee")),
        (3, isc.replace("Permission to use", "Permission not use")),
        (4, "Licensed under CC BY 4.0"),
        (5, "Licensed under CC ND 4.0"),
        (6, isc.replace("with or without fee", "WITH OR WITHOUT fee")),
        # a phrase far from the rest of its template is not its phrase
        (7, isc.replace("with or without fee", "") + " filler" * 200 + " with or without fee"),
    ]
    got = {r.doc: r.labels.split(",") for r in licenses.scan(docs(rows)).collect()}
    assert [k for k in got if "bsd-text" in got[k]] == [0]
    assert sorted(k for k in got if "isc-text" in got[k]) == [1, 6]
    assert sorted(k for k in got if "cc-by-4.0-notice" in got[k]) == [4]


def brute(texts):
    """Labels and score of every text: rarity by counting texts, alignments by trying every place, phrases by comparing words."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    seen = Counter(w for ws in words for w in set(ws))
    out = []
    for ws in words:
        labels, score = {label for phrase, label in BASE.items() if f" {phrase} " in f" {' '.join(ws)} "}, 0.0
        for t in TEMPLATES:
            own = re.findall("[a-z0-9]+", t.text.lower())
            telling = {k: w for k, w in enumerate(own) if w not in STOP}
            rare = sorted(set(telling.values()) & set(ws), key=lambda w: (seen[w], w))[: licenses.RARE]
            phrases = [p.split() for p in t.phrases]
            for at in {p - k for p, w in enumerate(ws) for k, v in telling.items() if w == v}:
                agree = [w for k, w in telling.items() if 0 <= at + k < len(ws) and ws[at + k] == w]
                if sum(w in rare for w in agree) < min(licenses.MIN_VOTES, len(telling)):
                    continue
                starts = [next(k for k in range(len(own)) if own[k : k + len(p)] == p) for p in phrases]
                if all(any(ws[x : x + len(p)] == p and abs(x - k - at) <= len(own) for x in range(len(ws))) for p, k in zip(phrases, starts)):
                    labels.add(t.name)
                    score = max(score, len(agree) / len(telling))
        out.append((",".join(sorted(labels)), score))
    return out


def test_labels_and_score_equal_brute_force(spark, docs):
    rng = random.Random(5)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in TEMPLATES * 16:
        ws = t.text.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(ws) + 1)
            ws[at : at + rng.randrange(2)] = rng.choice((["software"], ["copies", "of"], [], ["license"]))
        texts.append(" ".join([*rng.choices(ws, k=rng.randrange(9)), *ws, *rng.choices(t.text.split(), k=5)]))
    got = {r.doc: (r.labels, r.score) for r in licenses.scan(docs(list(enumerate(texts)))).collect()}
    want = brute(texts)
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(w[0] for w in want))
    assert all(math.isclose(got[k][1], w[1], abs_tol=1e-12) for k, w in enumerate(want))
    found = Counter(x for w in want for x in w[0].split(","))
    assert all(found[t.name] > 0 for t in TEMPLATES) and any(0 < w[1] < 1 for w in want)


def test_rarity_is_the_corpus_own(docs):
    """The words a template is looked up by follow the rows scanned: common ones come last."""
    text = next(t.text for t in TEMPLATES if t.name == "isc-text")
    rows = [(i, "copyright notice") for i in range(9)] + [(9, text)]
    files = docs(rows).selectExpr("transform(split(lower(text), ' '), (w, i) -> struct(w, i as p)) as hits")
    order = licenses._by_rarity(files, TEMPLATES)["isc-text"]
    assert set(order[-2:]) == {"copyright", "notice"} and order[0] not in text.lower().split()
