import re

from diffcorpus.llm import licenses
from diffcorpus.llm.license_texts import BASE, TEMPLATES
from diffcorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, names = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for k in range(len(ws)):
            if ws[k : k + len(p)] == p:
                at.append(k)
                names.add(label)
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))


def test_query_base_equals_brute_force(spark):
    want = {r.doc_id: base(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["op2_licenses"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in out} == want and any(v[1] for v in want.values())
    for r in out:
        names = r.labels.split(",") if r.labels else []
        assert names == sorted(set(names)) and set(r.base_labels.split(",")) - {""} <= set(names) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(set(names) - set(BASE.values()))


def test_templates_are_found_whole_and_inside_prose(docs):
    rows = [(i, f"some words before it {t.text} and others after") for i, t in enumerate(TEMPLATES)]
    # the words alone, out of order or without a mandatory phrase, are no licence
    rows += [(100, "license mit the under released"), (101, "Released under the MIT kind of License")]
    got = {r.doc: r for r in licenses.scan(docs(rows)).collect()}
    for i, t in enumerate(TEMPLATES):
        assert t.name in got[i].labels.split(",") and got[i].score == 1.0
    assert got[100].labels == "" and got[101].labels == ""


def test_odd_rows(spark, odd, empty, docs):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    out = sorted(((r.doc, *tuple(r)[1:6]) for r in licenses.scan(odd).collect()), key=str)
    assert out == sorted(((d, *base(t)) for d, t in rows), key=str)
    assert licenses.scan(empty).count() == 0
    # a letter that only full case folding maps to ASCII is another word; repeats and ties of one phrase all count
    one = docs([(1, "MIT License mit LICENSE, mit-license"), (2, "MİT LİCENSE mıt license"), (None, "apache license"), (None, "apache license")])
    got = sorted(((str(r.doc), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(one).collect()))
    assert got == [("1", 6, 3, 0, 4, "mit"), ("2", 4, 0, None, None, ""), ("None", 2, 1, 0, 0, "apache"), ("None", 2, 1, 0, 0, "apache")]


def test_plan_runs_no_python(spark, docs, capsys):
    licenses.scan(docs([(1, "mit license")])).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
