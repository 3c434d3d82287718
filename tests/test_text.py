"""Text, metadata and measures on hand-worked values."""

from pyspark.sql import functions as F

from lexiforge.functions import measures as X
from lexiforge.functions import metadata as M
from lexiforge.functions import text as T
from lexiforge.operators import clean as C


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [tuple(r[1:]) for r in rows.select("i", *columns).orderBy("i").collect()]


def one(spark, texts, column):
    return [v for (v,) in values(spark, texts, column)]


def test_normal_forms(spark):
    text = F.col("text")
    assert one(spark, ["  A\tB\n c "], T.normalise(text)) == ["a b c"]
    assert one(spark, [" a\x07b  c "], T.clean(text)) == ["ab c"]
    assert one(spark, ["Naïve-é, x.y!"], T.similarity_form(text)) == ["naïve-é x.y"]
    assert one(spark, ["a b c d e f", "a b", ""], T.shingles(text)) == [["a b c d e", "b c d e f"], ["a b"], [""]]


def test_tokens_and_keywords(spark):
    text = F.col("text")
    assert one(spark, ["The NR uses TS 36.331, the x NR"], T.bm25_tokens(text)) == [["the", "nr", "uses", "ts", "36.331", "ts 36.331"]]
    assert one(spark, ['LTE and TS36 with "Some Term" v1.2.3 kéa ABC'], T.keywords(text)) == [["ABC", "LTE", "SOME TERM", "TS36", "V1.2.3"]]
    assert "KASME" in one(spark, ["kasme key"], T.keywords(text))[0]
    assert one(spark, ["kéa"], T.keywords(text)) == [[]]
    assert one(spark, ["Handover\nKey results:\nbase station"], T.phrases(text)) == [["base station", "handover", "handover\nkey results"]]


def test_headers(spark):
    lines = ["1.2 Scope", "A Sentence starts", "IV ", "Chapter x", "ALL CAPS HEADER LINE", "## Mark", "plain"]
    assert one(spark, lines, T.section_type(F.col("text"))) == ["numbered", "letter", None, "keyword", "caps", "markdown", None]
    assert one(spark, ["1.2 Some title", "THREE CAPITAL WORDS", "TWO CAPITALS"], T.header_v1(F.col("text"))) == [True, True, False]


def test_sentences(spark):
    text = "One two. Three four! Five six seven eight nine ten. Z."
    got = one(spark, [text, "short"], T.sentences(F.col("text"), 20))
    assert got[1] == ["short"] and all(len(p) <= 21 for p in got[0])
    assert "".join(got[0]).replace(" ", "") == text.replace(" ", "")


def test_questions(spark):
    text = F.col("text")
    assert one(spark, ["unit", "tell more", "what is the value of this thing here"], T.continues(text)) == [True, True, False]
    assert one(spark, ["unit"], T.continues(text, by_token=True)) == [False]
    assert one(spark, ["everything about security mode"], T.section_request(text)) == ["security mode"]
    assert one(spark, ["is the gap"], T.query_phrases(text)) == [["is the gap", "the gap", "is the gap"]]
    assert one(spark, ["gap of cell"], T.expansions(text)) == [["gap of cell", "distance of cell", "spacing of cell", "separation of cell", "gap of site"]]
    assert [tuple(x)[:2] for x in one(spark, ["AB1234 Router"], T.query_ids(text))[0]] == [("AB1234", "id"), ("ROUTER", "term")]


def test_small_functions(spark):
    text = F.col("text")
    assert one(spark, ["# a", "1.2.3 b", "x"], T.heading_level(text)) == [1, 3, 1]
    assert one(spark, ["Fig. 2.3 and image 4"], T.figure_references(text)) == [["Fig. 2.3", "Fig. 2.3", "image 4"]]
    assert one(spark, ["abcdefgh"], T.truncate_to_tokens(text, 1)) == ["abcd..."]
    assert one(spark, ["a/b:c"], T.safe_name(text)) == ["a_b_c"]
    table = T.table_text(F.lit("C"), F.array(F.lit("h")), F.array(F.array(F.lit("1")), F.array(F.lit("2"))))
    assert one(spark, ["x"], table) == ["Table: C\nh\n" + "-" * 50 + "\n1\n2"]


def test_versions(spark):
    paths = ["d/doc_v1.2.3.pdf", "x_rel15.pdf", "guide_L16A.pdf", "m_2023-06.pdf", "plain.pdf"]
    assert one(spark, paths, M.version_score(F.col("text"))) == [10203, 1500, 1665, 202306, 0]
    assert one(spark, paths, M.family(F.col("text"))) == ["doc", "x", "guide", "m", "plain"]
    assert one(spark, ["Ericsson_MIMO_L16A.pdf"], M.family(F.col("text"))) == ["ericsson_mimo"]
    seqs = spark.createDataFrame([(1, "a_v1.0.pdf"), (2, "a_v2.0.pdf"), (3, "b.pdf"), (4, "a_v2.0.txt")], "seq int, path string")
    assert sorted(r.seq for r in C.newest_versions(seqs).collect()) == [2, 3]
    delimited = spark.createDataFrame([(1, "m_v1.10.pdf"), (2, "m_v1.9.pdf"), (3, "n_2021.pdf")], "seq int, path string")
    assert sorted(r.seq for r in C.newest_delimited(delimited).collect()) == [1, 3]


def test_metadata(spark):
    text = "# Title here\nNokia guide to TS 38.331 handover in the RAN"
    got = values(spark, [text], M.vendor(F.col("text")), M.doc_type(F.col("text")), M.topics(F.col("text")), M.title(F.col("text")), M.spec_number(F.col("text")))
    assert got == [("nokia", "specification", ["mobility", "ran"], "Title here", "TS 38.331")]
    assert one(spark, ["x/38-series/ts_rel16.pdf"], M.release(F.col("text"))) == [16]
    assert one(spark, ["x/38-series/ts_rel16.pdf"], M.series(F.col("text"))) == ["38"]
    assert one(spark, ["f_v2.1"], M.document_id(F.lit(None), F.lit("TS 1"), F.lit("2"), F.col("text"))) == ["ts1_v2"]


def test_noise(spark):
    body = "word " * 60
    pages = ["short", "x" * 300, body + "confidential", body, "1. a ...... 5\n2.3.4.5.6 b ..... 12\n" * 12]
    got = one(spark, pages, C.noise_reason(F.col("text")))
    assert got[:4] == ["too_short", "few_words", "pattern:confidential", None] and got[4].startswith("pattern:")


def test_measures(spark):
    frame = spark.createDataFrame([([1, 2, 3], [2, 3, 4], 7, 6)], "a array<int>, b array<int>, x long, y long")
    row = frame.select(X.jaccard(F.col("a"), F.col("b")), X.dot(F.col("a"), F.col("b")), X.hamming_similarity(F.col("x"), F.col("y")), X.agreement(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (0.5, 20.0, 1 - 1 / 64, 0.0)
