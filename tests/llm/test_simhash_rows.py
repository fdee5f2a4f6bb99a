from diffcorpus.llm import simhash


def test_one_row_of_each_group_whatever_the_ids(docs):
    """A repeated id must not take its unique text away; copies of one id, or of none, are one document."""
    copy, same, none = "a text that is there twice over", "rows alike in id and text too", "copies that no id names at all"
    rows = [(3, copy), (7, copy), (7, "quite another text under that id"), (9, same), (9, same), (9, same), (None, none), (None, none), (None, copy)]
    df = docs(rows)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, copy), (7, rows[2][1]), (9, same), (None, none)], key=str)
    assert simhash.keep_first(df.limit(0)).count() == 0
