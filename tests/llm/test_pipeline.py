"""The pipeline on a small corpus with planted cases, each stage judged on its own input."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_planted_cases(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(3000)]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    docs, labels = [], []
    for i in range(200):
        t, bad = text(80), i % 10 == 0
        if bad:
            w = t.split(" ")
            for k in range(6):
                w.insert(k * 9, ["grimbold", "snarfed"][k % 2])
            t = " ".join(w)
        docs.append((i, t))
        if i < 150:
            labels.append((i, 1, int(bad)))
    item, passage = text(30), text(70)
    docs += [(300, docs[1][1]), (301, docs[2][1] + " more"), (302, text(20) + " " + item + " " + text(20)), (303, text(9) + " " + passage + " " + text(30)), (304, text(11) + " " + passage + " " + text(31)), (305, "")]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept, frame = [], spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, path).write.parquet(f"{path}/{name}")
        frame = spark.read.parquet(f"{path}/{name}")
        kept.append({x["doc_id"]: x for x in frame.collect()})
        if k < 4:
            assert frame.columns == corpus_pipeline.COLUMNS
    toxic = set(range(0, 200, 10))
    everything = {i for i, _ in docs}
    assert set(kept[0]) == everything - toxic
    assert set(kept[1]) == set(kept[0]) - {300, 301}
    assert set(kept[2]) == set(kept[1]) and passage not in kept[2][303]["text"] and passage not in kept[2][304]["text"]
    assert kept[2][5]["text"] == docs[5][1] and kept[2][303]["n_chars"] == len(kept[2][303]["text"])
    assert set(kept[3]) == set(kept[2]) - {302}
    assert set(kept[4]) == set(kept[3]) and kept[4][305]["n_tokens"] == 0
