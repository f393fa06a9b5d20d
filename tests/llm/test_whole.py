"""Cases that earlier versions of the corpus operators left out."""

import hashlib

from pagespine.llm.queries import QUERIES


def folder(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_short_lines_repeat(spark, tmp_path):
    long = "a line of thirty characters or more, "
    docs = [(1, "Yes.\n\nNo.\n \nYes."), (2, f"Yes.\n\nNo!\n \n{long}a"), (3, f"{long}b\nYes"), (4, None)]
    want = {1: "Yes.\n\nNo.\n ", 2: f"\nNo!\n \n{long}a", 3: "Yes", 4: None}
    done = QUERIES["op3_line_dedup"](spark, folder(spark, tmp_path, documents=(docs, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in done} == {i: t if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert {r["doc_id"]: r["n_removed"] for r in done} == {1: 1, 2: 1, 3: 1, 4: 0}
