from fixtures import empty_documents, odd_documents
from oracle import connect, same

from siftline.llm import lines


def test_oracle(spark):
    same(lines.op4_line_site_spread(spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), lines.OP4_SQL)


def docs_with(spark, spread, sites=30):
    """A line for each number of sites in spread, and a line of each document's own."""
    rows = []
    for i in range(sites):
        own = [f"line of {n}" for n in spread if i < n]
        rows.append((i, "\n".join([*own, f"own {i}", ""]), "en", f"site{i}", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_threshold_is_exact(spark):
    out = lines.dedup_lines(docs_with(spark, range(1, 25))).orderBy("doc_id").collect()
    assert out[0].text.startswith("line of 1\n")  # the smallest id keeps everything
    for r in out[1:]:
        assert r.text == "\n".join([*[f"line of {n}" for n in range(1, 10) if r.doc_id < n], f"own {r.doc_id}", ""])


def test_sites_not_documents_count(spark):
    rows = [(i, "same line\n\n  \nown", None, "one", 1) for i in range(50)] + [(99, " same line\r", None, None, 1), (100, None, None, "two", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.text for r in lines.dedup_lines(docs).collect()} == {"same line\n\n  \nown", " same line\r", None}


def test_odd_documents(spark):
    docs = odd_documents(spark)
    out = lines.dedup_lines(docs, min_sites=2)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert lines.dedup_lines(empty_documents(spark)).count() == 0


def test_many_shared_lines(spark):
    """Documents that lose thousands of lines: more than are looked through one by one."""
    shared = [f"line {i}" for i in range(3000)]
    texts = {i: "\n".join([*shared, f"own {i}", "", *shared[:5]]) for i in range(12)}
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == {i: t if i == 0 else f"own {i}\n" for i, t in texts.items()}
