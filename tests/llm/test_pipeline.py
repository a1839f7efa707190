import hashlib

import corpus_pipeline
from landshift.llm import quality_model, queries
from landshift.llm.common import read
from tests.llm.test_operators import components, cut, library, plain


def test_stages_one_by_one(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        kept[name] = after = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            model = quality_model.train(read(spark, sf, "documents"), read(spark, sf, "labels"))
            want = {r["doc_id"] for r in quality_model.score(read(spark, sf, "documents"), model).where("score >= 0.3").collect()}
            assert set(after) == want and 0.7 < len(want) / len(before) < 0.95
        if k == 1:
            assert set(after) == {i for i, _, _, keep in components(before.items(), 5, 80) if keep}
        if k == 2:
            assert sorted((str(i), " ".join(r["text"].encode().decode().split())) for i, r in after.items()) == sorted((i, " ".join(t.split())) for i, _, _, t in cut(list(before.items()), corpus_pipeline.PASSAGE))
            assert all(r["n_chars"] == len(r["text"]) or r["text"] == before[i] for i, r in after.items())
        if k == 3:
            items = [s for r in read(spark, sf, "benchmark").collect() if (s := plain(r["text"]))]
            assert set(after) == {i for i, t in before.items() if not any(len(plain(t) & s) >= 0.8 * len(s) for s in items)}
        if k == 4:
            t = library()
            for i, r in after.items():
                assert r["ids"] == t.encode(before[i] or "", add_special_tokens=False).ids
                assert r["decoded"] == t.decode(r["ids"], skip_special_tokens=False)


def test_odd_documents_pass_the_stages(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


#: Column names that the stages use beside the documents' own.
CLASHES = ["kept_doc", "kept_text", "found_text", "starts_of_marks", "doc_of_marks", "tag_of_marks", "measured", "_starts", "kept_id", "found_id", "family", "tag", "text_hash", "starts"]


def test_stages_with_clashing_names_and_no_rows(spark):
    item = read(spark, "/root/testdata/sf0.001", "benchmark").first()["text"]
    prose = " ".join(f"word{k}" for k in range(60))
    rows = [(1, prose), (1, prose), (None, prose), (2, prose + " end"), (3, f"{item} {prose}"), (None, f"so {item}"), (4, None), (5, "")]
    names = ["doc_id", "text", "n_chars", *CLASHES]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` int" for c in CLASHES)
    docs = spark.createDataFrame([(i, t, len(t or ""), *range(len(CLASHES))) for i, t in rows], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert none.count() == 0
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if k < 4:
            assert out.columns == names and out.schema == docs.schema
        got = sorted(out.select("doc_id", *(["text"] if k < 4 else [])).collect(), key=str)
        ids = sorted((r["doc_id"] for r in got), key=str)
        if k == 1:  # 2 is a near copy of 1, and one row of 1 stays; rows without doc_id stay
            assert ids == sorted([1, None, 3, None, 4, 5], key=str) or ids == sorted([1, None, None, 4, 5], key=str)
        if k == 2:  # 1's rows and those without doc_id keep all
            left = [(r["doc_id"], r["text"]) for r in got]
            assert left.count((1, prose)) == 2 and (None, prose) in left and (2, "end") in left and (4, None) in left and (3, f"{item} ") in left
        if k == 3:
            assert ids == sorted([1, 1, None, 2, 4, 5], key=str)
        if k == 4:
            assert len(ids) == len(rows)


def test_queries_are_whole(spark, sf_dir):
    n = read(spark, sf_dir, "documents").count()
    assert set(queries.QUERIES) == {q for q in queries.QUERIES if q.startswith("op")} and len(queries.QUERIES) == 13
    assert queries.op5_substring_dedup(spark, sf_dir).where("doc_id IS NOT NULL").count() == n
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["kept_sha256"] for r in queries.op5_substring_dedup(spark, sf_dir).where("n_words = 0").collect()} <= {empty}
