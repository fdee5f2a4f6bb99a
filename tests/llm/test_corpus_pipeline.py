from test_decontaminate import brute as hits
from test_simhash import brute as groups

import corpus_pipeline
from diffcorpus.llm import secret_scan, toxicity
from diffcorpus.llm.queries import PIECES
from diffcorpus.llm.stages import bucket_of, stage
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r for r in docs.collect()})
    whole = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    clean, single, cut, safe = kept

    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(source, labels, usable=bucket_of("doc_id", 5) != 0)
    assert clean.keys() == {r.doc for r in toxicity.score(source, model).where("score < 0.5").collect()}
    assert all(clean[i] == whole[i] for i in clean)

    rows = [(i, r.text) for i, r in clean.items()]
    assert single.keys() == {d for d, _, c in groups(rows) if d == c} and all(single[i] == whole[i] for i in single)

    assert cut.keys() == single.keys()
    hit = {d for d, _, n, _ in hits([(i, r.text) for i, r in single.items()], bench) if n}
    assert hit and all((cut[i].text == single[i].text) == (i not in hit) for i in single)
    assert not any(n for _, _, n, _ in hits([(i, cut[i].text) for i in hit], bench))

    assert safe.keys() == cut.keys() and all(r.n_chars == len(r.text) for r in safe.values())
    frame = spark.createDataFrame(list(cut.values()), docs.schema)
    secret = {}
    for r in secret_scan.find_secrets(frame).where("is_secret").collect():
        secret.setdefault(r.doc, []).append(r.found)
    assert secret.keys() == {i for i in cut if cut[i].text != safe[i].text}
    assert all(s not in safe[i].text for i, found in secret.items() for s in found)

    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.where("round_trip AND n_ids = size(ids)").collect()} == safe.keys()


def test_run_and_odd_documents(spark, odd, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"] and PIECES
    for rows in (odd.drop("doc", "fp"), odd.limit(0)):
        folder = tmp_path / str(rows.count())
        rows.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (6, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, "gamma delta"), (None, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.where(~F.col("round_trip")).count() == 0
        assert (out.count() > 0) == (rows.count() > 0)
