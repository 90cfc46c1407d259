"""Each stage of the pipeline against brute force on what the stage before it kept."""

import numpy as np
import pytest
from test_operators import brute, brute_components, brute_pii, toxic_corpus

from tessella.llm import toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, items, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    toxic = [(1000 + i, t, y) for i, t, y in toxic_corpus(600, 2)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in corpus] + [(i, t, "en", "s", len(t)) for i, t, _ in toxic] + [(None, "no id at all here", "en", "s", 17)]
    rows.append(rows[20])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    for name, stage in P.STAGES:
        out = P.materialise(stage(spark, docs, sf_dir), name)
        after = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            flagged = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
            assert sorted(map(str, after)) == sorted(str(r) for r in before if r["doc_id"] not in flagged)
            truth = {1000 + i for i, _, y in toxic_corpus(600, 2) if y}
            assert len(flagged & truth) > 0.9 * len(truth) and len(flagged - truth) < 12
        elif name == "near_duplicates":
            want = {c for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in before]) if i is not None}
            ids = [r["doc_id"] for r in after if r["doc_id"] is not None]
            assert sorted(ids) == sorted(want) and len(ids) < len(before)
        elif name == "decontamination":
            hit = {b[0] for b in brute([(r["doc_id"], r["text"]) for r in before], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]) if b[5]}
            assert hit and sorted(str(r["doc_id"]) for r in after) == sorted(str(r["doc_id"]) for r in before if r["doc_id"] not in hit)
        elif name == "pii":
            old = {r["doc_id"]: r for r in before}
            assert len(after) == len(before)
            for r in after:
                spans = brute_pii(old[r["doc_id"]]["text"])
                assert not any(s[2] in ("email", "card") for s in brute_pii(r["text"]))
                if r["text"] is not None:
                    assert r["n_chars"] == len(r["text"]) and (not spans or r["text"] != old[r["doc_id"]]["text"])
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
            fill = {}
            for r in after:
                fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
            assert max(fill.values()) <= 1024 and np.mean(list(fill.values())) > 900
        docs, before = out, after


def test_run_is_the_last_stage(spark, sf_dir):
    import corpus_pipeline as P

    assert P.run(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and P.ORACLE_SQL is None


def test_rows_are_removed_for_their_own_id_and_text(spark, tmp_path):
    """Ids that occur with several texts, and null ids: one row of each component stays, and contaminated rows go alone."""
    import corpus_pipeline as P

    say = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(3, say("a"), "en"), (5, say("a") + " more", "en"), (5, say("b"), "en"), (7, say("c"), "en"), (7, say("d"), "en"), (8, say("e"), "en"), (8, say("e"), "de"), (9, None, "en"), (9, None, "en"), (9, " ", "en")]
    rows += [(None, say("a"), "en"), (None, say("f"), "en"), (None, say("f"), "en"), (None, say("f") + " more", "en"), (None, "", "en"), (None, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r) for r in P.drop_near_duplicates(spark, docs, "").collect()]
    f = [r for r in got if r[1] and r[1].startswith("f")]
    assert len(f) == 1 and f[0] in rows
    want = [(3, say("a"), "en"), (5, say("b"), "en"), (7, say("c"), "en"), (7, say("d"), "en"), (8, say("e"), "de"), (9, None, "en"), (9, " ", "en"), (None, "", "en"), (None, "", "en"), *f]
    assert sorted(map(str, got)) == sorted(map(str, want))

    spark.createDataFrame([(1, say("b")), (2, say("f"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [tuple(r) for r in P.drop_contaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, left)) == sorted(str(r) for r in rows if not (r[1] or "").startswith(("b", "f")))


def test_near_duplicates_share_five_words_and_four_fifths(spark):
    """Against brute force, with pairs on both sides of 0.8; 22 scattered words of 1000 are 0.801."""
    import corpus_pipeline as P

    rows = []
    for g, (n, changed) in enumerate([(1000, 22), (1000, 23), (100, 2), (100, 3), (40, 1), (4, 0), (3, 1)]):
        base = [f"g{g}w{i}" for i in range(n)]
        other = list(base)
        for i in range(changed):
            other[(2 * i + 1) * n // (2 * changed)] += "x"
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(other))]
    cut = lambda t: (w := t.split(" "), {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))})[1]
    sets = {i: cut(t) for i, t in rows}
    gone = {i + 1 for i in sets if i % 10 == 0 and 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])}
    assert 1 in gone and 11 not in gone and len(gone) < 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in P.drop_near_duplicates(spark, docs, "").collect()} == set(sets) - gone


def test_empty_tables_pass_all_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
